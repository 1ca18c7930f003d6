from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing as M
from tessera.llm.vocabulary import byte_bpe


def test_rake_meets_marginals():
    rng = np.random.default_rng(0)
    members = [np.repeat(np.arange(4), 15), np.tile(np.repeat(np.arange(3), 5), 4), np.tile(np.arange(5), 12)]
    tokens = rng.integers(500, 5000, 60).astype(float)
    targets = [np.full(4, 0.25), np.array([0.5, 0.3, 0.2]), np.full(5, 0.2)]
    fit = M.rake(tokens, members, targets, 0.2 * tokens.sum())
    assert fit.missed < 1e-8 and (fit.kept <= tokens + 1e-6).all()
    for group, share in zip(members, targets, strict=True):
        assert np.allclose(np.bincount(group, fit.kept) / fit.kept.sum(), share, atol=1e-6)
    # the fit is the starting table scaled by a factor for each class: odds ratios stay
    table = (fit.kept / tokens).reshape(4, 3, 5)
    assert np.allclose(table[0, 0] * table[1, 1], table[0, 1] * table[1, 0], rtol=1e-4)


def test_rake_respects_what_is_there():
    fit = M.rake(np.array([10.0, 1000.0]), [np.array([0, 1])], [np.array([0.5, 0.5])], 500.0)
    assert fit.kept == pytest.approx([10.0, 490.0])
    assert M.rake(np.zeros(0), [np.zeros(0, int)], [np.zeros(0)], 0.0).kept.size == 0


def test_sample_follows_probabilities(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = M.mix(docs, keep_share=0.5)
    rows = M.rated(docs, keep_share=0.5)
    total = rows.agg(F.sum("tokens")).first()[0]
    got = out.agg(F.sum("tokens"), F.sum(F.col("tokens") * F.col("weight")), F.max("probability")).first()
    assert 0.42 * total < got[0] < 0.58 * total and 0.85 * total < got[1] < 1.15 * total and got[2] <= 1 + 1e-9
    ids = {r["doc_id"]: len(byte_bpe().encode(r["text"] or "")) for r in docs.limit(50).collect()}
    have = {r["doc_id"]: r["tokens"] for r in rows.collect()}
    assert all(have[k] == v for k, v in ids.items())
    assert [r[0] for r in out.select("doc_id").orderBy("doc_id").collect()] == [r[0] for r in M.mix(docs.repartition(5), keep_share=0.5).select("doc_id").orderBy("doc_id").collect()]


def test_targets_nulls_and_repeats(spark):
    rows = [(k, "word " * 50, "a" if k % 4 else "b", "en") for k in range(400)]
    rows += [(1000, None, "a", "en"), (1001, "", None, None), (None, "some words", "a", ""), (5, "word " * 50, "a", "en"), (1002, "x" * 100000, "b", "en")]
    docs = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, source string, lang string, tokens int")
    options = {"targets": {"source": {"a": 0.5, "b": 0.5}}, "keep_share": 0.4}
    out = M.mix(docs, **options)
    share = {r["source"]: r["t"] for r in M.rated(docs, **options).groupBy("source").agg(F.sum(F.col("tokens") * F.col("probability")).alias("t")).collect()}
    assert share["a"] == pytest.approx(share["b"], rel=1e-3) and share[None] == 0
    assert out.filter("doc_id = 5").count() in (0, 2)
    assert M.mix(docs.limit(0)).count() == 0


def test_every_source_and_language_is_a_class(spark):
    """300 sources and 40 languages: small ones are tempered on their own, and a target that names one is met."""
    rows = spark.range(300).selectExpr("concat('s', id) AS source", "concat('l', id % 40) AS lang", "'t0' AS topic", "IF(id < 256, 1000L, 10L) AS tokens")
    rated = M.mixing_rates(rows, power=0.5, keep_share=0.2).collect()
    assert {r["source_class"] for r in rated} == {f"s{k}" for k in range(300)}
    assert {r["lang_class"] for r in rated} == {f"l{k}" for k in range(40)}
    small = {r["probability"] for r in M.mixing_rates(rows.withColumn("lang", F.lit("x")), power=0.5, keep_share=0.2).collect() if r["tokens"] == 10}
    assert max(small) - min(small) < 1e-6 and min(small) == pytest.approx(1.0)
    named = M.mixing_rates(rows.withColumn("lang", F.lit("x")), targets={"source": {"s0": 0.5, "s299": 0.5}}, keep_share=0.001).collect()
    assert {r["source"]: r["probability"] > 0 for r in named if r["source"] in ("s0", "s1", "s299")} == {"s0": True, "s1": False, "s299": True}


def plain_vector(text):
    """Weights by slot of a text's words of five bytes or more, one byte at a time."""
    counts = Counter()
    for word in (text or "").encode().replace(b"\x0b", b" ").replace(b"\x0c", b" ").split():
        if len(word) >= M.LONG_WORD:
            key, power = 0, 1
            for byte in word:
                key, power = (key + (byte + 1) * power) % 2**64, power * int(M.WORD_BASE) % 2**64
            counts[((key ^ key >> 32) * 0xBF58476D1CE4E5B9 % 2**64) >> (64 - M.SLOT_BITS)] += 1
    total = sum(counts.values())
    return {s: max(1, round(M.UNIT * (n / total) ** 0.5)) for s, n in counts.items()}


def plain_topics(vectors, order, topics):
    """k-means, one document and one centre at a time; ``order`` names the documents that the first centres are chosen from."""
    unit = lambda v: {s: round(x * (M.CENTRE_UNIT / sum(y * y for y in v.values()) ** 0.5)) for s, x in v.items()}
    dot = lambda a, b: sum(x * b.get(s, 0) for s, x in a.items())
    points = [unit(vectors[k]) for k in order]
    centres, draws = [points[0]], np.random.default_rng(0)
    while len(centres) < topics:
        gaps = [max(0, 1 - max(dot(p, c) for c in centres) / M.CENTRE_UNIT**2) ** 2 for p in points]
        aim, seen = draws.random() * sum(gaps), 0.0
        for p, gap in zip(points, gaps, strict=True):
            seen += gap
            if seen > aim:
                centres.append(p)
                break
    own = {}
    for _ in range(M.TOPIC_STEPS + 1):
        own = {k: max(range(len(centres)), key=lambda c: (dot(v, centres[c]), -c)) for k, v in vectors.items() if v}
        sums = [defaultdict(int) for _ in centres]
        for k, c in own.items():
            for s, x in vectors[k].items():
                sums[c][s] += x
        moved = [unit(s) if s else c for s, c in zip(sums, centres, strict=True)]
        if _ == M.TOPIC_STEPS or moved == centres:
            break
        centres = moved
    return {k: f"t{own[k]}" if v else "" for k, v in vectors.items()}


def plain_rates(cells, power, keep_share):
    """Kept share of each cell (source, language, topic): classic raking, a cell at a time."""
    total = sum(cells.values())
    kept = {c: n * keep_share for c, n in cells.items()}
    goals = []
    for d in range(3):
        sums = Counter()
        for c, n in cells.items():
            sums[c[d]] += n
        share = {v: n**power for v, n in sums.items()}
        goal, open_, left = {}, set(share), keep_share * total
        while open_:
            scale = left / sum(share[v] for v in open_)
            full = {v for v in open_ if share[v] * scale >= sums[v]}
            for v in full or open_:
                goal[v] = sums[v] if full else share[v] * scale
            left -= sum(goal[v] for v in full)
            open_ = open_ - full if full else set()
        goals.append(goal)
    for _ in range(M.FIT_STEPS):
        worst = 0.0
        for d, goal in enumerate(goals):
            have = Counter()
            for c, n in kept.items():
                have[c[d]] += n
            worst = max([worst, *(abs(have[v] - g) / (keep_share * total) for v, g in goal.items())])
            kept = {c: min(cells[c], n * (goal[c[d]] / have[c[d]] if have[c[d]] else 0)) for c, n in kept.items()}
        if worst < M.TOLERANCE:
            break
    return {c: n / cells[c] if cells[c] else 0.0 for c, n in kept.items()}


def test_query_against_brute_force(spark, sf_dir):
    """The registered query on the smallest table: topics, probabilities and the drawn documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", "text", "source", "lang").collect()
    vectors = {r["doc_id"]: plain_vector(r["text"]) for r in rows}
    packed = {k: b"".join(int(s).to_bytes(2, "little") + int(x).to_bytes(2, "little") for s, x in sorted(v.items())) for k, v in vectors.items()}
    hashed = spark.createDataFrame([(k, bytearray(v)) for k, v in packed.items() if v], "k long, v binary").select("k", F.xxhash64(F.lit("topics"), "v").alias("h"), F.hex("v").alias("v"))
    order = {r["v"]: r["k"] for r in sorted(hashed.collect(), key=lambda r: (r["h"], r["v"]))}  # equal vectors once
    topic = plain_topics(vectors, list(order.values()), M.TOPICS)
    tokens = {r["doc_id"]: len(byte_bpe().encode(r["text"] or "")) for r in rows}
    cell = {r["doc_id"]: (r["source"] or "", r["lang"] or "", topic[r["doc_id"]]) for r in rows}
    cells = Counter()
    for k, c in cell.items():
        cells[c] += tokens[k]
    rates = plain_rates(cells, 0.7, 0.5)
    want = {k: rates[c] if tokens[k] else 0.5 for k, c in cell.items()}
    draw = {r["doc_id"]: r["u"] for r in docs.select("doc_id", (F.shiftrightunsigned(F.xxhash64(F.lit(0), F.col("doc_id").cast("string")), 11) / float(1 << 53)).alias("u")).collect()}
    got = {r["doc_id"]: r for r in M.op3_mixing(spark, sf_dir).collect()}
    assert set(got) == {k for k, u in draw.items() if u < want[k]} and 0 < len(got) < len(rows)
    for k, r in got.items():
        assert r["topic"] == topic[k] and r["tokens"] == tokens[k] and r["probability"] == pytest.approx(want[k], abs=1e-6)


def test_drawn_sample_meets_the_marginals(spark):
    """Shares of the drawn tokens in all three dimensions are the targets, within sampling error."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("source", F.concat(F.lit("s"), F.col("doc_id") % 3)).withColumn("lang", F.concat(F.lit("l"), F.col("doc_id") % 2))
    rated = M.rated(docs, targets={"source": {"s0": 2, "s1": 1, "s2": 1}, "lang": {"l0": 0.6, "l1": 0.4}}, power=0.5, keep_share=0.4)
    rows = rated.collect()
    assert rows[0]["missed"] < 1e-6
    expected = sum(r["tokens"] * r["probability"] for r in rows)
    for dim, want in (("source", {"s0": 0.5, "s1": 0.25, "s2": 0.25}), ("lang", {"l0": 0.6, "l1": 0.4})):
        for v, share in want.items():
            assert sum(r["tokens"] * r["probability"] for r in rows if r[dim] == v) / expected == pytest.approx(share, abs=1e-4)
    sums = Counter()
    for r in rows:
        sums[r["topic"]] += r["tokens"]
    got = {t: sum(r["tokens"] * r["probability"] for r in rows if r["topic"] == t) for t in sums}
    scale = [got[t] / n**0.5 for t, n in sums.items() if got[t] < 0.999 * n]  # a topic that has too little gives all it has
    assert len(scale) >= 2 and max(scale) == pytest.approx(min(scale), rel=1e-3)
    taken = [r for r in rows if r["kept"]]
    spread = sum(r["tokens"] ** 2 * r["probability"] * (1 - r["probability"]) for r in rows) ** 0.5
    assert abs(sum(r["tokens"] for r in taken) - expected) < 4 * spread


def test_rows_without_ids_and_repeated_rows(spark):
    rows = [(None, f"words number {k} here", "a", "en") for k in range(200)] + [(1, "same same words", "b", None)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    out = M.mixed_documents(docs, keep_share=0.5).collect()
    assert 60 < sum(r["doc_id"] is None for r in out) < 140 and sum(r["doc_id"] == 1 for r in out) in (0, 3)
    assert M.mixed_documents(docs.limit(0)).count() == 0
