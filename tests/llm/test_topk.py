import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import topk as T


LONG = 2**63


def brute(rows, k=10):
    clamp = lambda x: min(LONG - 1, max(-LONG, x))
    good = [(i, [clamp(math.floor(x * 1024)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (q, own) in enumerate(good):
        if q % 100 == 0:
            scores = [(clamp(sum(x * y for x, y in zip(own, v, strict=True))), i) for b, (i, v) in enumerate(good) if a != b and len(v) == len(own)]
            out += [(q, rank, i, s) for rank, (s, i) in enumerate(sorted(scores, key=lambda t: (-t[0], t[1]))[:k], 1)]
    return sorted(out)


def run(spark, rows, **how):
    df = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<double>, row int")
    out = T.top_inner_products(T.integer_vectors(df), F.col("vec_id") % 100 == 0, **how)
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in out.collect())


@pytest.mark.parametrize("how", [{}, {"candidate_rows": 64, "query_rows": 3, "head": 2}, {"candidate_rows": 16, "query_rows": 5, "growth": 2}])
def test_against_brute_force(spark, how):
    rng, draw = np.random.default_rng(3), random.Random(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8) * draw.choice([0.1, 1, 4])]) for i in range(-300, 900)]
    rows += [(i, rows[i % 7][1]) for i in range(2000, 2040)]  # ties
    rows += [(5000, None), (5100, [1.0] * 7 + [None]), (5200, [float("nan")] * 8), (5300, [float("inf")] * 8), (None, [1.0] * 8), (0, rows[5][1]), (0, rows[5][1])]
    assert run(spark, rows, **how) == brute(rows)


def test_few_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(100, [1.0, 0.0])]) == []
    assert run(spark, [(100, [1.0, 0.0]), (7, [0.5, 0.5]), (3, [0.5, 0.5])]) == brute([(100, [1.0, 0.0]), (7, [0.5, 0.5]), (3, [0.5, 0.5])])


def test_lengths_repeats_and_large_components(spark):
    rng = np.random.default_rng(9)
    rows = [(100 * k, [float(x) for x in rng.normal(size=3)]) for k in range(4)] * 2 + [(100 * k, [float(x) for x in rng.normal(size=5)]) for k in range(3)]
    rows += [(7, [1e300, 0.0, 0.0]), (9, [-1e300, 1.0, 0.0]), (300, [3e12, 2e12, -1.0]), (400, [2e12, 3e12, 5.0]), (8, []), (500, [1.0])]
    assert run(spark, rows, candidate_rows=4, query_rows=2) == brute(rows)


def test_bounds_prune_vectors_of_uneven_length():
    """Length alone ends the search early, and the residual bound rules out most of what is left."""
    rng = np.random.default_rng(5)
    basis = np.linalg.qr(rng.normal(size=(32, 32)))[0]
    scale = np.concatenate((np.full(4, 30.0), np.full(28, 1.0)))
    c = np.rint((rng.normal(size=(4000, 32)) * scale) @ basis.T * np.exp(0.1 * rng.normal(size=4000))[:, None] * 1000).astype(np.int64)
    c = c[np.argsort(-(c.astype(float) ** 2).sum(axis=1), kind="stable")]
    ids = np.column_stack((np.arange(4000), np.arange(4000)))
    qid = np.column_stack((np.arange(20), np.arange(20) + 10_000))
    q = c[rng.integers(0, 4000, 20)]
    turn = np.linalg.svd(c.astype(float), full_matrices=False)[2].T
    first = T.search_block(qid, q, np.full(20, -np.inf), ids[:400], c[:400], turn, head=4)
    rest = T.search_block(qid, q, first.floor, ids[400:], c[400:], turn, head=4)
    assert rest.scored < 0.05 * 20 * 3600
    without = T.search_block(qid, q, first.floor, ids[400:], c[400:], turn, head=0)  # the length of both is all that is known
    assert rest.scored < 0.5 * without.scored < 0.5 * 20 * 3600
