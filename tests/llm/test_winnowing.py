import hashlib
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import winnowing as W

TEXTS = ["", None, " ", "one", "one two three four", "a b c d e", "A  b\tc d\ne f g h i j", "x " * 300, "Ünï cödé wörds änd möre öf thëm hére ünd dört nöch ëin", "same text here with enough words to see", "same text here with enough words to see"]


def mask(x):
    return x & (2**64 - 1)


def rot(x, n):
    return mask(x << n) | (x >> (64 - n)) if n else x


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def plain(text, k=5, window=4):
    """(hash, position) selected by winnowing, written out."""
    words = [w for w in re.split("[\x20\x09-\x0d]+", (text or "").lower()) if w]
    hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    if not words:
        return []
    if len(words) >= k:
        grams = []
        for i in range(len(words) - k + 1):
            h = 0
            for j in range(k):
                h ^= rot(hashes[i + j], k - 1 - j)
            grams.append(signed(h))
    else:  # one k-gram of all words: Spark's hash of the array of word hashes
        h = 42
        for x in hashes:
            h = xxhash.xxh64_intdigest(x.to_bytes(8, "little"), h)
        grams = [signed(h)]
    spans = [range(i, i + window) for i in range(len(grams) - window + 1)] or [range(len(grams))]
    chosen = {min(s, key=lambda i: (grams[i], -i)) for s in spans}
    return [(grams[i], i) for i in sorted(chosen)]


def plain_likeness(one, two):
    a, b = ({h for h, _ in plain(t)} for t in (one, two))
    return len(a & b) / len(a | b) if a | b else 1.0


def test_long_texts_and_full_hashes(spark):
    """Hashes keep all 64 bits, and positions beyond 2**16 are right."""
    text = " ".join(f"u{k}" for k in range(70_000))
    got = W.fingerprints(spark.createDataFrame([(text,)], "text string")).first()["fingerprint"]
    assert [(e["hash"], e["position"]) for e in got] == plain(text)
    assert max(e["position"] for e in got) > 2**16 and len({e["hash"] & 0xFFFF for e in got}) > 10_000


def test_selection(spark, sf_dir):
    texts = TEXTS + [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40).collect()]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r["i"]: [(e["hash"], e["position"]) for e in r["fingerprint"]] for r in W.fingerprints(df).collect()}
    for i, t in enumerate(texts):
        assert got[i] == plain(t), t


def test_match_guarantee(spark):
    shared = " ".join(f"w{k}" for k in range(W.K + W.WINDOW - 1))
    df = spark.createDataFrame([("p q r s t u v " + shared + " x y z",), ("aa bb " + shared + " cc dd ee ff gg",)], "text string")
    one, two = (set(e["hash"] for e in r["fingerprint"]) for r in W.fingerprints(df).collect())
    assert one & two


@pytest.mark.parametrize("range_rows", [2048, 3])
def test_edited_texts(spark, range_rows, monkeypatch):
    monkeypatch.setattr(W, "RANGE_ROWS", range_rows)
    monkeypatch.setattr(W.with_next, "__kwdefaults__", {"id_col": "doc_id", "range_rows": range_rows})
    rows = [(i * 7 - 20, t) for i, t in enumerate(TEXTS)] + [(None, "null id text of some length here")]
    got = {r["doc_id"]: r for r in W.edited_and_next(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_chars int").repartition(3)).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    for k, (doc, text) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        n = len(text) // 3
        edited = text[: len(text) - n] + following[:n]
        assert got[doc]["edited"] == edited and got[doc]["n_chars"] == len(text), doc


def test_lone_document_and_empty_table(spark):
    one = W.edited_and_next(spark.createDataFrame([(5, "abcdefghi")], "doc_id long, text string")).first()
    assert one["edited"] == "abcdefabc" and one["next_hashes"] == one["fp_hashes"]
    assert W.edited_and_next(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark, sf_dir):
    out = W.op10_winnowing(spark, sf_dir)
    rows = out.collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    ids = sorted(docs, reverse=True)
    for r in rows:
        text, following = docs[r["doc_id"]] or "", docs[ids[(ids.index(r["doc_id"]) + 1) % len(ids)]] or ""
        n = len(text) // 3
        assert r["edited_sha256"] == hashlib.sha256((text[: len(text) - n] + following[:n]).encode()).hexdigest()
        assert r["near_edited"] == pytest.approx(plain_likeness(text, text[: len(text) - n] + following[:n]))
        assert r["near_next"] == pytest.approx(plain_likeness(text, following))
    same = {}
    for r in rows:
        assert same.setdefault(docs[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]
    assert sum(r["near_edited"] > r["near_next"] for r in rows) > 0.95 * len(rows)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.select(F.min("n_chars")).first()[0] >= 0
