import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import packing as P


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=40))
def test_best_fit(sizes):
    where, offset, fills = P.best_fit(np.array(sizes, dtype=np.int64), 20)
    bins = defaultdict(list)
    for b, o, s in zip(where, offset, sizes, strict=True):
        bins[b].append((o, s))
    for b, items in bins.items():
        at = 0
        for o, s in sorted(items):
            assert o == at
            at += s
        assert at == fills[b] <= 20
    free = sorted(20 - fills)  # no bin of the result fits into another
    assert len(free) < 2 or min(fills) > free[-1] or len(free) == len(bins)


def test_cut():
    assert P.cut(1024) == [1024] and P.cut(2500) == [452, 1024, 1024] and P.cut(1) == [1]


@pytest.mark.parametrize("parts", [1, 20])
def test_pieces_against_the_library(spark, sf_dir, parts):
    rows = [(-1, None), (-2, ""), (-3, "word " * 4000)] + [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = P.pack(spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, bin int").repartition(parts)).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, total = {}, 0
    for doc, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        start, total = 0, total + len(ids)
        for k, n in enumerate(P.cut(len(ids))):
            want[doc, k] = (start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes()))
            start += n
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for items in bins.values():
        at = 0
        for o, n in sorted(items):
            assert o == at
            at += n
        assert at <= 1024
    best = len(P.best_fit(np.array([n for _, n, _ in want.values()]), 1024)[2])
    assert len(bins) <= best * (1.0 if parts == 1 else 1.06) + 1


def test_empty_and_repeated(spark):
    assert P.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = P.pack(spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "doc_id long, text string").coalesce(1)).collect()
    assert len(rows) == 3 and len({r["sequence_id"] for r in rows}) == 1 and sorted(r["offset"] for r in rows) == [0, 2, 4]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_plan_is_best_fit_of_everything(sizes):
    counts = {n: sizes.count(n) for n in set(sizes)}
    rows = sorted(map(tuple, P.plan(counts, 20).tolist()))
    bins = defaultdict(list)
    for n, count in counts.items():
        own = [r for r in rows if r[0] == n]
        for rank in range(count):
            _, first, sequence, offset = max(r for r in own if r[1] <= rank)
            bins[sequence + rank - first].append((offset, n))
    for items in bins.values():
        at = 0
        for o, n in sorted(items):
            assert o == at
            at += n
        assert at <= 20
    assert len(bins) == len(P.best_fit(np.array(sizes, dtype=np.int64), 20)[2])
    assert not bins or set(bins) == set(range(len(bins)))


def test_partitions_of_unlike_lengths_share_sequences(spark):
    """100 documents of 600 tokens in one partition and 100 of 400 in the other: 100 sequences."""
    docs = spark.range(0, 200, 1, 2).selectExpr("id AS doc_id", "repeat(' the', IF(id < 100, 599, 399)) AS text")
    got = P.pack(docs).collect()
    assert sorted({r["length"] for r in got}) == [400, 600] and len(got) == 200
    assert len({r["sequence_id"] for r in got}) == 100
