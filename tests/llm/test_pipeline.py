import base64
import math
import random
import string
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import simhash
from tests.llm.test_simhash import plain_shingles


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "mixing", "packing"]


def test_language_and_near_duplicates(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    more = spark.createDataFrame([(-1, None, None, "s", 0), (-2, "12345 !!", "en", "s", 8), (-3, "", "en", "s", 0)], docs.schema)
    kept = stage("language")(spark, docs.unionByName(more), sf_dir)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert not ids & {-1, -2, -3} and len(ids) >= 0.98 * docs.count()
    out = stage("near_duplicates")(spark, docs.unionByName(docs.limit(3)), sf_dir)
    assert out.columns == docs.columns
    got = {r["doc_id"] for r in out.collect()}
    sets = {r["doc_id"]: set(plain_shingles(r["text"], 5)) for r in docs.collect()}
    first = {i: min(j for j, b in sets.items() if len(a & b) >= 0.8 * len(a | b)) for i, a in sets.items()}
    twins = {i for i, j in first.items() if j < i}
    assert out.count() == len(got) and not (set(sets) - got) - twins
    assert len(twins - got) >= 0.9 * len(twins) > 0


def test_null_ids_shared_ids_and_long_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = [r["text"] for r in docs.filter("lang = 'en' AND length(text) > 400").select("text").distinct().orderBy("text").limit(4).collect()]
    odd = [(None, text[0], "en", "s", 1), (None, text[1], "en", "s", 1), (-7, text[2], "en", "s", 1), (-7, text[3], "en", "s", 1), (-8, " ".join(text) * 300, "en", "s", 1)]
    more = spark.createDataFrame(odd, docs.schema)
    for name in ("language", "near_duplicates"):
        assert sorted(r["text"] for r in stage(name)(spark, more, sf_dir).collect()) == sorted(r[1] for r in odd), name
    out = stage("mixing")(spark, more, sf_dir).collect()
    assert {r["text"] for r in out} <= {r[1] for r in odd} and sum(r["doc_id"] == -7 for r in out) in (0, 2)
    packed = stage("packing")(spark, more, sf_dir).collect()
    assert sum(r["doc_id"] is None and r["start"] == 0 for r in packed) == 2


def test_clashing_columns_and_empty_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = docs.withColumn("score", docs.doc_id).withColumn("simhash", docs.doc_id).withColumn("topic", docs.lang)
    for name, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, odd, sf_dir)
        assert out.columns == odd.columns, name
        assert out.filter("score <> doc_id").count() == 0, name
        assert f(spark, odd.limit(0), sf_dir).count() == 0, name
    assert stage("packing")(spark, odd.limit(0), sf_dir).count() == 0


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "piece", "sequence_id", "offset", "length"} <= set(out.columns)
    assert out.count() > 0 and out.groupBy("sequence_id").agg({"length": "sum"}).filter("`sum(length)` > 1024").count() == 0


def test_language_stage_rejects_junk_and_unlearned_languages(spark, sf_dir):
    rng = random.Random(0)
    odd = [
        " ".join("".join(rng.choices(string.ascii_lowercase, k=7)) for _ in range(200)),
        base64.b64encode(rng.randbytes(900)).decode(),
        "for (int i=0;i<n;i++){ if(!ptr->nxt) goto xerr; buf[i]^=0x5f; memcpy(dst,src,sizeof(*dst)); }",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw.",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan.",
        "Все люди рождаются свободными и равными в своем достоинстве и правах.",
    ]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    more = spark.createDataFrame([(-1 - k, t, None, "s", len(t)) for k, t in enumerate(odd)], docs.schema)
    ids = {r["doc_id"] for r in stage("language")(spark, docs.unionByName(more), sf_dir).collect()}
    assert ids == {r["doc_id"] for r in docs.collect()}


def test_forests_name_the_texts_whose_links_they_leave_out():
    """Every link within the radius is found or lies among the texts that are named."""
    rng = np.random.default_rng(0)
    prints = np.array([sum(1 << int(b) for b in rng.choice(12, 2, replace=False)) for _ in range(400)] + [int(x) << 32 for x in rng.integers(0, 1 << 30, 100)], np.uint64)
    rank = prints.copy()
    for k in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(k)
    prints = prints[np.argsort(rank, kind="stable")]
    found, dense = [], []
    simhash.gray_links(np.zeros(len(prints), np.int64), prints, found=found, forests=3, dense=dense)
    linked = {frozenset(e) for a, b, _ in found for e in zip(a.tolist(), b.tolist(), strict=True)}
    named = set(np.concatenate(dense).tolist())
    near = {frozenset((i, j)) for i in range(len(prints)) for j in range(i) if int(prints[i] ^ prints[j]).bit_count() <= 3}
    missed = near - linked
    assert len(missed) > 1000 and all(e <= named for e in missed) and len(named) < len(prints)


def test_links_that_forests_leave_out_are_found_by_shared_shingles(spark):
    rng = np.random.default_rng(1)
    sets = [set(rng.choice(60, 40, replace=False).tolist()) for _ in range(30)]
    sets += [(s - set(list(s)[: k % 6])) | {100 + k} for k, s in enumerate(sets)]
    rows = [(k, sorted(s)) for k, s in enumerate(sets)]
    alike = {(i, j) for j in range(len(sets)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    sketches = spark.createDataFrame([(k, [k % 4, (1 << 40) - 1 if k % 4 else 0]) for k in range(len(sets))], "vertex long, sketch array<long>")
    table = spark.createDataFrame(rows, "vertex long, shingles array<long>")
    known = spark.createDataFrame([(0, 0), (30, 0)], "vertex long, component long")
    got = {(r["src"], r["dst"]) for r in simhash.prefix_candidates(table, sketches, known, 0.8, 3).collect()}
    assert (0, 30) in alike and alike - {(0, 30)} <= got and (0, 30) not in got and len(alike) > 20


def test_couples_that_first_meet_too_far_down_are_no_rows(spark):
    """Near copies of one text that differ in too much: each holds 100 shared shingles and 20 of its own (similarity 0.71), but one couple is alike."""
    sets = [list(range(100)) + list(range(1000 + 20 * k, 1020 + 20 * k)) for k in range(40)]
    sets.append(sets[7][:-5] + [9999])
    table = spark.createDataFrame(list(enumerate(sets)), "vertex long, shingles array<long>")
    sketches = spark.createDataFrame([(k, [0]) for k in range(41)], "vertex long, sketch array<long>")
    none = spark.createDataFrame([], "vertex long, component long")
    assert [(r["src"], r["dst"]) for r in simhash.prefix_candidates(table, sketches, none, 0.8, 3).collect()] == [(7, 40)]


def test_couples_that_meet_early_and_differ_too_much_are_no_rows(spark):
    """Copies of one text that each lack 8 of its 100 shingles and hold 8 others: all meet early, but no two of the first 40 are alike."""
    rng = random.Random(5)
    sets = []
    while len(sets) < 40:
        new = set(range(100)) - set(rng.sample(range(100), 8)) | set(range(1000 + 8 * len(sets), 1008 + 8 * len(sets)))
        if all(len(new ^ old) > 22 for old in sets):
            sets.append(new)
    sets.append(sets[7] - {min(sets[7])} | {9999})
    table = spark.createDataFrame([(k, sorted(s)) for k, s in enumerate(sets)], "vertex long, shingles array<long>")
    sketches = spark.createDataFrame([(k, [0]) for k in range(41)], "vertex long, sketch array<long>")
    none = spark.createDataFrame([], "vertex long, component long")
    alike = {(i, j) for j in range(41) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    got = {(r["src"], r["dst"]) for r in simhash.prefix_candidates(table, sketches, none, 0.8, 3).collect()}
    assert (7, 40) in alike and alike <= got and len(got) <= 60


def test_connected_groups_are_not_paired_with_themselves(spark):
    """200 alike sets of one component and 30 of no component, of many sizes: all alike couples meet, those of one component hardly ever."""
    rng = random.Random(6)
    base = set(range(2000, 2150))
    group = [base - set(rng.sample(sorted(base), rng.randrange(6))) | {10_000 + 10 * k + i for i in range(rng.randrange(6))} for k in range(200)]
    single = [base - set(rng.sample(sorted(base), rng.randrange(25))) | {50_000 + 40 * k + i for i in range(rng.randrange(25))} for k in range(30)]
    sets = dict(enumerate([*group, *single]))
    often = {}
    for s in sets.values():
        for x in s:
            often[x] = often.get(x, 0) + 1
    rows = []
    for k, s in sets.items():
        order = sorted(s, key=lambda x: (often[x], x))
        first = len(s) - math.ceil(0.8 * len(s)) + 1
        rows += [(k, len(s), len(s) - i, x, 0 if k < 200 else k) for i, x in enumerate(order[:first]) if often[x] > 1]
    prefix = spark.createDataFrame(rows, "vertex long, size int, left int, shingle long, component long")
    a, b = simhash.meeting_sides(prefix, 0.8)
    key = ["shingle", "band", "most"]
    met = a.select(*key, F.col("vertex").alias("v"), F.col("component").alias("c")).join(b.select(*key, F.col("vertex").alias("w"), F.col("component").alias("d")), key).collect()
    want = {frozenset((i, j)) for i in sets for j in range(200, 230) if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert len(want) > 500 and want <= {frozenset((r["v"], r["w"])) for r in met if r["c"] != r["d"]}
    inside = sum(r["c"] == r["d"] for r in met)
    all_inside = sum(n * n for n in Counter(x for k, _, _, x, _ in rows if k < 200).values())
    assert all_inside > 20_000 and inside < all_inside / 20


def test_parities_differ_in_no_more_bits_than_sets_in_shingles(spark):
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(-(2**63), 2**63, int(n))) for n in (0, 1, 7, 900, 5000)]
    sets += [np.concatenate((s[: len(s) // 2], [k])) for k, s in enumerate(sets)]
    table = spark.createDataFrame([(k, s.tolist()) for k, s in enumerate(sets)], "vertex long, shingles array<long>")
    parity = {r["vertex"]: np.array(r["parity"], np.int64) for r in simhash.with_parities(table).collect()}
    for i, a in enumerate(sets):
        assert sum(int(x).bit_count() for x in parity[i].view(np.uint64)) == sum(np.bincount(a & 1023, minlength=1024) & 1)
        for j, b in enumerate(sets):
            assert int(np.bitwise_count((parity[i] ^ parity[j]).view(np.uint64)).sum()) <= len(np.setxor1d(a, b))


def test_no_link_of_a_dense_group_is_lost(spark, monkeypatch):
    """Texts whose fingerprints are near and most of which are not alike: the groups are those of all links, not of three forests."""
    rng = random.Random(3)
    base = [f"w{k}" for k in range(260)]
    texts = []
    for _ in range(45):
        words = list(base)
        for k in rng.sample(range(260), 9):
            words[k] = f"x{rng.randrange(10**6)}"
        texts.append(words)
        again = list(words)
        again[rng.randrange(260)] = f"y{rng.randrange(10**6)}"
        texts.append(again)
    rows = [(k, " ".join(w)) for k, w in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sketch = {r["doc_id"]: r["sketch"] for r in simhash.with_proposals(docs).collect()}
    sets = [set(plain_shingles(t, 5)) for _, t in rows]
    own = list(range(len(rows)))
    for j in range(len(rows)):
        for i in range(j):
            near = any(((x ^ y) & (2**64 - 1)).bit_count() <= 3 for x, y in zip(sketch[i], sketch[j], strict=True))
            if near and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and own[i] != own[j]:
                low, high = sorted((own[i], own[j]))
                own = [low if o == high else o for o in own]
    monkeypatch.setattr(simhash, "FORESTS", 1)
    monkeypatch.setattr(simhash, "FIRST_WORDS", 1)
    kept = {r["doc_id"] for r in simhash.representatives(docs).collect()}
    assert kept == set(own) and len(kept) < len(rows)
