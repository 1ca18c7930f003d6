import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import simhash as S


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []


def plain_sketch(text, n=16):
    """n fingerprints of two-word shingles, from the first hashes and from mixtures of them."""
    first, out, full = [xxhash.xxh64_intdigest(s.encode(), 42) for s in plain_shingles(text, 2)], [], 2**64 - 1
    for w in range(n):
        hashes = []
        for h in first:
            if w:
                h = (h + w * 0x9E3779B97F4A7C15) & full
                h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & full
                h = (h ^ h >> 27) * 0x94D049BB133111EB & full
                h ^= h >> 31
            hashes.append(h)
        out.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    return out


def alike(a, b, least=0.8):
    a, b = set(plain_shingles(a, 5)), set(plain_shingles(b, 5))
    return len(a & b) >= least * len(a | b)


def plain_groups(rows, n=16):
    """Smallest index of each row's group: links are near in a fingerprint and alike in their five-word shingles."""
    sketches = [plain_sketch(t, n) for t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if min((x ^ y).bit_count() for x, y in zip(sketches[i], sketches[j], strict=True)) <= 3 and alike(rows[i], rows[j]):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(rows))]


def plain_components(ids, prints, radius=3):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in zip(ids, prints, strict=True):
        for j, b in zip(ids, prints, strict=True):
            if i < j and (a ^ b).bit_count() <= radius:
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


TEXTS = ["", None, "  \t\n", "one", "One  TWO", "one two", "a b c", "A\tb\x0bc", "Ärger ist groß", "ärger ist groß", "x " * 5000, "same words here again and again", "same words here again and again", "dot. dot. dot.\x1c\x85 nbsp kept"]


def test_fingerprints_and_components_against_brute_force(spark, sf_dir):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(1000 + r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, simhash string")
    got = {r["doc_id"]: r for r in S.near_duplicates(df).collect()}
    want = [plain_print(t) for _, t in rows]
    assert {i: got[i]["simhash"] & (2**64 - 1) for i, _ in rows} == dict(zip([i for i, _ in rows], want, strict=True))
    assert {i: r["component_id"] for i, r in got.items()} == plain_components([i for i, _ in rows], want)


def test_bit_counts():
    rng = np.random.default_rng(0)
    hashes = rng.integers(0, 2**64, 2000, dtype=np.uint64)
    starts = np.array([0, 0, 3, 3, 258, 513, 514, 1500, 2000, 2000])
    got = S.bit_counts(hashes, starts)
    for k in range(len(starts) - 1):
        part = [int(h) for h in hashes[starts[k] : starts[k + 1]]]
        assert got[k].tolist() == [sum(h >> b & 1 for h in part) for b in range(64)]
    assert (S.bit_counts(np.full(1000, 2**64 - 1, np.uint64), np.array([0, 1000])) == 1000).all()


def variants(rng, n, size=150, most=9):
    """A text and copies of it with up to ``most`` words replaced."""
    base = [f"w{k}" for k in rng.integers(0, 500, size)]
    out = [" ".join(base)]
    for _ in range(n):
        words = list(base)
        for p in rng.integers(0, size, int(rng.integers(0, most + 1))):
            words[p] = f"x{rng.integers(0, 500)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize(("cell_rows", "few"), [(10**6, 8), (12, 8), (10**6, 0)])
def test_representatives_against_brute_force(spark, monkeypatch, cell_rows, few):
    """Families of a few variants: exactly the groups of all links.  A dense family, whose members are near in many
    fingerprints and mostly not alike: nothing is joined that is not linked, and at most one in twenty links is missed."""
    rng = np.random.default_rng(2)
    odd = [None, "", "  ", "one", "One ", "a b c d e f"]
    dense = variants(rng, 40)
    small = [t for _ in range(8) for t in variants(rng, 4, 60, 2)]
    texts = [*odd, *small, *dense]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain_confirmed = S.confirmed
    monkeypatch.setattr(S, "confirmed", lambda edges, sets, least, **how: plain_confirmed(edges, sets, least, few=few, **how))
    got = sorted(r["doc_id"] for r in S.representatives(df, cell_rows=cell_rows).collect())
    want = sorted(set(plain_groups(texts)))
    first = len(odd) + len(small)
    assert [i for i in got if i < first] == [i for i in want if i < first]
    assert set(want) <= set(got) and len(got) - len(want) <= len(dense) / 20
    assert 14 <= len([i for i in want if i < first]) < first - 10


def test_recall_of_alike_texts(spark):
    """Of couples with a five-word similarity of 0.8 to 0.95, at least nine in ten lose a member; none below 0.8 does."""
    rng = np.random.default_rng(7)
    rows, couples = [], []
    while len(couples) < 300:
        size = int(rng.integers(60, 400))
        words = [f"v{k}" for k in rng.zipf(1.3, size) % 5000]
        other = list(words)
        for p in rng.integers(0, size, max(1, int(size * rng.uniform(0.01, 0.035)))):
            other[p] = f"y{rng.integers(0, 5000)}"
        a, b = set(plain_shingles(" ".join(words), 5)), set(plain_shingles(" ".join(other), 5))
        j = len(a & b) / len(a | b)
        if 0.7 <= j < 0.95:
            couples.append(j)
            rows += [(2 * len(couples), " ".join(words)), (2 * len(couples) + 1, " ".join(other))]
    kept = {r["doc_id"] for r in S.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    lost = [2 * k + 3 not in kept for k in range(len(couples))]
    assert not any(gone for j, gone in zip(couples, lost, strict=True) if j < 0.8)
    near = [gone for j, gone in zip(couples, lost, strict=True) if j >= 0.8]
    assert len(near) > 100 and sum(near) >= 0.9 * len(near)


def test_representatives_of_odd_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, copy long")
    assert S.representatives(empty).count() == 0
    rows = [(None, "a b c", 1), (None, "a b c", 1), (None, "d e f", 1), (5, "g h i", 1), (5, "j k l", 1), (5, "j k l", 2), (7, "D E F ", 0)]
    got = [tuple(r) for r in S.representatives(spark.createDataFrame(rows, "doc_id long, text string, copy long")).collect()]
    assert {(r[0], r[1]) for r in got} == {(None, "a b c"), (7, "D E F "), (5, "g h i"), (5, "j k l")} and len(got) == 4


@pytest.mark.parametrize("cell_rows", [10**6, 3])
def test_links_of_clustered_fingerprints(spark, cell_rows):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 2**63, 12, dtype=np.uint64)
    prints = {0}
    for c in centres:
        for _ in range(25):
            f = int(c)
            for b in rng.integers(0, 64, rng.integers(0, 4)):
                f ^= 1 << int(b)
            prints.add(f)
    prints = sorted(prints)
    signed = [(i, p - 2**64 if p >= 2**63 else p) for i, p in enumerate(prints)]
    from tessera.operators.graph import connected_components

    edges = S.links(spark.createDataFrame(signed, "rep long, simhash long"), cell_rows=cell_rows)
    got = {r["vertex"]: r["component"] for r in connected_components(edges).collect()}
    want = plain_components(range(len(prints)), prints)
    assert {i: got.get(i, i) for i in want} == want


def test_gray_links_dense_cell():
    rng = np.random.default_rng(1)
    prints = np.unique(rng.integers(0, 2**14, 3000).astype(np.uint64))
    rank = prints.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    prints = prints[np.argsort(rank)]
    labels = S.gray_links(np.zeros(len(prints), np.int64), prints)
    want = plain_components(range(len(prints[:400])), [int(x) for x in prints[:400]])
    part = S.gray_links(np.zeros(400, np.int64), prints[:400])
    assert part.tolist() == [want[i] for i in range(400)]
    assert (labels == 0).all()


def test_edge_cases(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(empty).count() == 0
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "w x y z w"), (None, "a b c d"), (1, "w x y z w"), (9, "quite another text")]
    got = sorted((r["doc_id"] or -1, r["component_id"]) for r in S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(-1, 1), (1, 1), (1, 1), (1, 1), (2, 1), (9, 9)]


def test_gray_rank_is_an_inverse_gray_code(spark):
    df = spark.range(256).select(F.col("id").bitwiseXOR(F.shiftright("id", 1)).alias("g"), "id")
    assert df.filter(S.gray_rank(F.col("g")) != F.col("id")).count() == 0
