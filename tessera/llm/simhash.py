"""SimHash near-duplicates: fingerprints, a Gray-order hierarchical index, components.

Fingerprints that differ in at most ``radius`` bits are linked.  If 64 bits are
cut into four segments, two fingerprints with three differing bits or fewer agree
on a whole segment; so every distinct fingerprint goes to one cell for each of
its segments, and cells are searched on their own.  A cell with very many
distinct fingerprints is cut again by segments of its remaining bits, down to
cells whose size is bounded by the bits that are left.  Within cells the
fingerprints are sorted by Gray rank, runs of neighbours share masked bit
patterns in the nodes above them, and pairs of nodes are dropped as a whole once
the differences in their shared bits exceed the radius.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import connected_components
from tessera.storage import bounded_batches, materialize, remove

from .rows import row_key
from .textbytes import per_document, runs

SHINGLE, RADIUS, SEED = 3, 3, 42
#: Bits of the four segments at each level of cells; below the last, 21 free bits at most tell fingerprints apart.
SEGMENTS = ((16, 16, 16, 16), (12, 12, 12, 12), (9, 9, 9, 9), (7, 7, 7, 6))
#: Distinct fingerprints beyond which a cell is cut again.
CELL_ROWS = 200_000
FANOUT, FRONTIER = 8, 32_768
#: Proposed links are kept so many times over, since not all of them are confirmed.
FORESTS = 3
#: In place of the bits of a link: one was left out for this text.
MARK = -1
#: Words whose links are judged first.
FIRST_WORDS = 4
#: Texts with the same fingerprint that the smallest cells hold.
REPEATS = 16
#: Bits of a parity of a shingle set, a power of two.
PARITY = 1024
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


#: The bits of a byte, one in each byte of a word: sums of up to 255 such words count all eight bits at once.
LANES = sum(((np.arange(256, dtype=np.uint64) >> np.uint64(i)) & np.uint64(1)) << np.uint64(8 * i) for i in range(8))


def bit_counts(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(spans, 64): how many of the hashes of each span [starts[i], starts[i + 1]) have each bit set."""
    size = np.diff(starts)
    parts = -(-size // 255)  # lanes hold 255 at most
    first = np.concatenate(([0], np.cumsum(parts)))
    total = int(first[-1])
    if total == 0:
        return np.zeros((len(size), 64), np.int64)
    within = np.arange(total) - np.repeat(first[:-1], parts)
    at = np.repeat(starts[:-1], parts) + 255 * within
    lanes = LANES[hashes[starts[0] : starts[-1]].view(np.uint8).reshape(-1, 8)]
    sums = np.add.reduceat(lanes, at - starts[0], axis=0)
    return per_document(np.ascontiguousarray(sums).view(np.uint8).reshape(total, 64).astype(np.int64), first)


def spread_hashes(hashes: np.ndarray, word: int) -> np.ndarray:
    """Further hashes from the first ones: multiply, shift and XOR after adding a multiple of an odd constant; word 0 is the first ones."""
    if word == 0:
        return hashes
    x = hashes + np.uint64(word * 0x9E3779B97F4A7C15 % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def word_bytes(data: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, size, bounds): the lower-cased words of all texts, each followed by a space; word w is
    ``text[start[w] : start[w] + size[w]]``, text i has the words bounds[i] to bounds[i + 1]."""
    data = LOWER[data]
    word = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True  # a text's bounds end words, too
    before = np.concatenate(([False], word[:-1])) & ~edge[:-1]
    after = np.concatenate((word[1:], [False])) & ~edge[1:]
    first, last = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after)
    size = last - first + 1
    at = np.concatenate(([0], np.cumsum(size + 1)))
    joined = np.full(int(at[-1]), 0x20, np.uint8)
    chars = np.flatnonzero(word)
    joined[np.arange(len(chars)) + np.repeat(np.arange(len(size)), size)] = data[chars]
    return joined.tobytes(), at, size, np.searchsorted(first, offsets)


def shingle_spans(at: np.ndarray, size: np.ndarray, bounds: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, starts): bytes of every run of ``shingle`` words (of fewer words: the whole sequence); text i has starts[i] to starts[i + 1]."""
    n_words = np.diff(bounds)
    n_shingles = np.where(n_words >= shingle, n_words - shingle + 1, np.minimum(n_words, 1))
    starts = np.concatenate(([0], np.cumsum(n_shingles)))
    doc = np.repeat(np.arange(len(n_words)), n_shingles)
    head = bounds[doc] + (np.arange(int(starts[-1])) - starts[doc])
    tail = np.minimum(head + shingle, bounds[doc + 1]) - 1
    return at[head], at[tail] + size[tail], starts


def span_hashes(text: bytes, begin: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(text[s:e], seed) for s, e in zip(begin.tolist(), end.tolist(), strict=True)], dtype=np.uint64)


def text_fingerprints(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE, seed: int = SEED, words: int = 1) -> np.ndarray:
    """(texts, words) fingerprints of 64 bits each of the texts in ``data``; see :func:`with_fingerprints`."""
    docs = len(offsets) - 1
    if len(data) == 0:
        return np.zeros((docs, words), np.uint64)
    text, at, size, bounds = word_bytes(data, offsets)
    begin, end, starts = shingle_spans(at, size, bounds, shingle)
    doc, total = np.repeat(np.arange(docs), np.diff(starts)), int(starts[-1])
    ones = np.zeros((words, docs, 64), np.int64)
    step = 1 << 15
    for a in range(0, total, step):
        b = min(total, a + step)
        hashes = span_hashes(text, begin[a:b], end[a:b], seed)
        lo, hi = doc[a], doc[b - 1] + 1
        spans = np.clip(starts[lo : hi + 1], a, b) - a
        for w in range(words):
            ones[w, lo:hi] += bit_counts(spread_hashes(hashes, w), spans)
    set_ = (2 * ones > np.diff(starts)[:, None]).astype(np.uint8)
    return np.ascontiguousarray(np.packbits(set_, axis=2, bitorder="little").view(np.uint64)[:, :, 0].T)


def with_fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED, words: int = 1) -> DataFrame:
    """(``id_col``, ``simhash`` as a signed long, ``sketch``) of every row; ``sketch`` holds
    ``words`` independent fingerprints as little-endian bytes, the first being ``simhash``.

    Whole texts, A-Z lower-cased, words between space and tab to carriage return,
    word shingles with repeats; a bit is 1 if set in over half the XXH64 hashes.
    Fewer words make one shingle of all; null, empty and blank texts give zero."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [text_fingerprints(data, offs, shingle, seed, words) for _, _, data, offs in runs(batch.column(1))]
            prints = np.concatenate(parts) if parts else np.zeros((0, words), np.uint64)
            first = np.ascontiguousarray(prints[:, 0]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(first), pa.array([p.astype("<u8").tobytes() for p in prints], pa.binary())], names=[id_col, "simhash", "sketch"])

    bounded_batches(docs.sparkSession)
    rows = docs.select(id_col, F.col(text_col).cast("string").alias("_text"))
    return rows.mapInArrow(compute, f"`{id_col}` {dict(rows.dtypes)[id_col]}, simhash long, sketch binary")


def gray_rank(bits: Column) -> Column:
    """Place of a bit string in the Gray order: the prefix XOR of its bits."""
    for shift in (1, 2, 4, 8, 16, 32):
        bits = bits.bitwiseXOR(F.shiftrightunsigned(bits, shift))
    return bits


def components_of(n: int, a: np.ndarray, b: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
    """Smallest index reachable from each of n vertices, starting from ``labels``."""
    labels = np.arange(n) if labels is None else labels
    while len(a):
        la, lb = labels[a], labels[b]
        keep = la != lb
        a, b, la, lb = a[keep], b[keep], la[keep], lb[keep]
        if not len(a):
            break
        low = np.minimum(la, lb)
        np.minimum.at(labels, la, low)
        np.minimum.at(labels, lb, low)
        while True:
            up = labels[labels]
            if np.array_equal(up, labels):
                break
            labels = up
    return labels


def lightest_forest(labels: np.ndarray, a: np.ndarray, b: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Indices of links that join the classes in ``labels`` as all links (a, b) do, those of fewest bits first (ties: the first)."""
    own, alive, picked = labels.copy(), np.arange(len(a)), [np.zeros(0, np.int64)]
    while True:
        la, lb = own[a[alive]], own[b[alive]]
        alive, la, lb = (x[la != lb] for x in (alive, la, lb))
        if not len(alive):
            return np.concatenate(picked)
        ends, link = np.concatenate((la, lb)), np.concatenate((alive, alive))
        order = np.lexsort((link, bits[link], ends))
        ends, link = ends[order], link[order]
        picked.append(np.unique(link[np.concatenate(([True], ends[1:] != ends[:-1]))]))
        own = components_of(len(own), a[picked[-1]], b[picked[-1]], own)


def gray_links(cell: np.ndarray, prints: np.ndarray, radius: int = RADIUS, found: list | None = None, forests: int = 1, known: np.ndarray | None = None, dense: list | None = None) -> np.ndarray:
    """For fingerprints sorted by (cell, Gray rank): the smallest index that links
    of at most ``radius`` bits within a cell lead to.  Links are added to ``found`` as
    (a, b, bits) arrays: a forest, light links first, that connects all they connect,
    then a forest of the links that are left, and so on up to ``forests``.  So a link
    that is not among them joins what as many separate paths of found links join.
    Rows of equal ``known`` values are taken to be connected from the start.  Every link that is not
    added to ``found`` lies within a class of the last forest; the indices of all rows of such classes are added to ``dense``.

    Levels of nodes over runs of FANOUT neighbours hold the bits that all below
    share (mask, pattern).  Pairs of nodes are expanded from the roots; a pair is
    dropped when its shared bits differ in more than ``radius`` places, or when
    all below it is known to be connected already."""
    n = len(prints)
    masks, patterns = [np.full(n, ~np.uint64(0))], [prints]
    starts, counts, cells = [None], [None], [cell]
    while len(cells[-1]) > 1 and (cells[-1][1:] == cells[-1][:-1]).any():
        own = cells[-1]
        fresh = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        within = np.arange(len(own)) - np.repeat(fresh, np.diff(np.append(fresh, len(own))))
        lead = np.flatnonzero(within % FANOUT == 0)
        every, some = np.bitwise_and.reduceat(patterns[-1], lead), np.bitwise_or.reduceat(patterns[-1], lead)
        mask = np.bitwise_and.reduceat(masks[-1], lead) & ~(every ^ some)
        masks.append(mask)
        patterns.append(every & mask)
        starts.append(lead)
        counts.append(np.diff(np.append(lead, len(own))))
        cells.append(own[lead])
    start = np.arange(n)
    if known is not None and n:
        _, first, own = np.unique(known, return_index=True, return_inverse=True)
        start = first[own]
    joined = [start.copy() for _ in range(forests)]
    same: list[np.ndarray] = []

    def refresh() -> None:
        same[:] = [joined[-1]]
        for lead in starts[1:]:
            low, high = np.minimum.reduceat(same[-1], lead), np.maximum.reduceat(same[-1], lead)
            low = np.where(low == high, low, -1 - np.arange(len(low)))
            same.append(low)

    refresh()
    top = len(masks) - 1
    roots = np.arange(len(masks[top]))
    stack = [(top, roots[i : i + FRONTIER], roots[i : i + FRONTIER]) for i in range(0, len(roots), FRONTIER)] if top else []
    pending = 0
    while stack:
        level, p, q = stack.pop()
        np_, nq = counts[level][p], counts[level][q]
        total = np_ * nq
        pair = np.repeat(np.arange(len(p)), total)
        k = np.arange(int(total.sum())) - np.repeat(np.cumsum(total) - total, total)
        a = starts[level][p][pair] + k // nq[pair]
        b = starts[level][q][pair] + k % nq[pair]
        level -= 1
        keep = a <= b if level else a < b
        a, b = a[keep], b[keep]
        differ = np.bitwise_count((patterns[level][a] ^ patterns[level][b]) & masks[level][a] & masks[level][b])
        keep = (differ <= radius) & ((same[level][a] != same[level][b]) | (same[level][a] < 0))
        a, b = a[keep], b[keep]
        if level:
            stack += [(level, a[i : i + FRONTIER], b[i : i + FRONTIER]) for i in range(0, len(a), FRONTIER)]
        if not level and len(a):
            bits = differ[keep]
            pending += len(a)
            for k in range(forests):
                light = lightest_forest(joined[k], a, b, bits)
                if found is not None:
                    found.append((a[light], b[light], bits[light]))
                joined[k] = components_of(n, a[light], b[light], joined[k])
                if k + 1 < forests:
                    left = np.ones(len(a), bool)
                    left[light] = False
                    a, b, bits = a[left], b[left], bits[left]
            if 4 * pending >= n:
                refresh()
                pending = 0
    if dense is not None:
        # a class of two known groups may hold further links between these, too
        last = joined[-1]
        several = np.zeros(n, bool)
        several[last[start != last]] = True
        dense.append(np.flatnonzero(several[last]))
    return joined[0]


def _cells(rows: DataFrame, level: int) -> DataFrame:
    """Each row once for every segment of its ``rest``; ``cell`` names the segment, its value and the cell it lay in."""
    sizes, low, parts = SEGMENTS[level], 0, []
    rest = F.col("rest")
    for k, bits in enumerate(sizes):
        value = F.shiftrightunsigned(rest, low).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
        above = F.shiftleft(F.shiftrightunsigned(rest, low + bits), low) if low + bits < 64 else F.lit(0).cast("long")
        below = rest.bitwiseAND(F.lit((1 << low) - 1).cast("long"))
        parts.append(F.struct(F.xxhash64(F.col("cell"), F.lit(k), value).alias("cell"), above.bitwiseOR(below).alias("rest")))
        low += bits
    return rows.withColumn("_part", F.explode(F.array(*parts))).select("rep", "known", "simhash", F.col("_part.cell").alias("cell"), F.col("_part.rest").alias("rest"))


def _links_in_cells(rows: DataFrame, radius: int, forests: int, marks: bool = False) -> DataFrame:
    """(src, dst, bits): links between representatives that connect what all links of a cell connect; see :func:`gray_links`."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def joined() -> tuple[np.ndarray, ...]:
            return tuple(np.concatenate(c) for c in zip(*held, strict=True))

        def flush(rows: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            shared = rows[0][1:] == rows[0][:-1]  # a fingerprint alone in its cell has no link there
            some = np.concatenate(([False], shared)) | np.concatenate((shared, [False]))
            cell, prints, rep, known = (c[some] for c in rows)
            found = [(np.zeros(0, np.int64),) * 3]
            dense: list[np.ndarray] = []
            gray_links(cell, prints.view(np.uint64), radius, found, forests, known, dense if marks else None)
            if marks:
                some = np.unique(np.concatenate(dense))
                found.append((some, some, np.full(len(some), MARK)))
            a, b, bits = (np.concatenate(c) for c in zip(*found, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(rep[a]), pa.array(rep[b]), pa.array(bits.astype(np.int32))], names=["src", "dst", "bits"])

        waiting = 0
        for batch in batches:
            held.append(tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)))
            waiting += batch.num_rows
            if waiting >= 1 << 18:
                rows = joined()
                other = np.flatnonzero(rows[0] != rows[0][-1])
                cut = int(other[-1]) + 1 if len(other) else 0
                if cut:
                    yield flush(tuple(c[:cut] for c in rows))
                held, waiting = [tuple(c[cut:] for c in rows)], len(rows[0]) - cut
        if waiting:
            yield flush(joined())

    dealt = rows.select("cell", "simhash", "rep", "known").repartition("cell").sortWithinPartitions("cell", gray_rank(F.col("simhash")))
    return dealt.mapInArrow(search, "src long, dst long, bits int")


def _hot_cells(rows: DataFrame, cell_rows: int) -> DataFrame | None:
    """Cells of more than ``cell_rows`` rows, None if there are none; cells are counted one by one only where the
    2**16 buckets that their hashes fall into leave that open."""
    bucket = F.pmod("cell", F.lit(1 << 16)).alias("bucket")
    full = rows.groupBy(bucket).count().filter(F.col("count") > cell_rows).select("bucket")
    if full.isEmpty():
        return None
    hot = rows.withColumn("bucket", bucket).join(full, "bucket", "left_semi").groupBy("cell").count().filter(F.col("count") > cell_rows).select("cell")
    return None if hot.isEmpty() else hot


def links(prints: DataFrame, *, radius: int = RADIUS, cell_rows: int = CELL_ROWS, forests: int = 1, marks: bool = False) -> DataFrame:
    """(src, dst, bits): links of at most ``radius`` bits between the representatives of fingerprints.

    ``prints`` has a row (``simhash``, ``rep``) for each fingerprint and, if there are
    independent fingerprints of a text, the number ``word`` that tells them apart;
    only equal numbers are compared.  Representatives of equal ``known`` (a long, optional)
    are connected already, and nothing is returned for them.  Enough links are returned to connect whatever
    is connected, ``forests`` times over, the lightest of a cell first; none joins fingerprints that are not alike.
    With ``marks`` there is a row (rep, rep, MARK) for each representative that a link was left out for."""
    if radius >= 4:
        raise ValueError("four segments find at most three differing bits")
    word = F.col("word") if "word" in prints.columns else F.lit(0)
    known = F.col("known") if "known" in prints.columns else F.col("rep")
    rows = prints.select("rep", known.alias("known"), "simhash", word.cast("long").alias("cell"), F.col("simhash").alias("rest"))
    found: DataFrame | None = None
    for level in range(len(SEGMENTS)):
        rows = _cells(rows, level)
        hot = _hot_cells(rows, cell_rows) if level + 1 < len(SEGMENTS) else None
        calm = rows if hot is None else rows.join(hot, "cell", "left_anti")
        part_ = _links_in_cells(calm, radius, forests, marks)
        found = part_ if found is None else found.unionByName(part_)
        if hot is None:
            break
        rows = materialize(rows.join(hot, "cell", "left_semi").select("rep", "known", "simhash", "cell", "rest"), "cells")
        if level + 2 == len(SEGMENTS):
            # of equal fingerprints REPEATS go on, the others are linked to one of these, so that the last cells are bounded by their free bits
            equal = ["cell", "simhash", "rest", "_k"]
            rows = rows.withColumn("_k", F.pmod(F.xxhash64("rep"), F.lit(REPEATS)))
            first = rows.groupBy(*equal).agg(F.min(F.struct("rep", "known")).alias("_f")).select(*equal, F.col("_f.rep").alias("first"), F.col("_f.known").alias("first_known"))
            others = rows.join(first, equal).filter("rep <> first AND known <> first_known")
            found = found.unionByName(others.select(F.col("first").alias("src"), F.col("rep").alias("dst"), F.lit(0).alias("bits")))
            if marks:
                short = rows.join(others.select("cell").distinct(), "cell", "left_semi").select("rep").distinct()
                found = found.unionByName(short.select(F.col("rep").alias("src"), F.col("rep").alias("dst"), F.lit(MARK).alias("bits")))
            rows = first.select("cell", "simhash", "rest", F.col("first").alias("rep"), F.col("first_known").alias("known"))
    return found


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(``id_col``, ``simhash``, ``component_id``) for every row.

    ``component_id`` is the smallest id that links of at most ``radius`` differing
    bits lead to, the row's own included.  Copies are one fingerprint, so only distinct
    fingerprints are searched.  Empty texts share fingerprint zero.  Rows that repeat
    an id each get a row and link whatever their texts link; a row without an id gets one,
    too, and links texts, but names no component (null if no row of its component has an id)."""
    spark = docs.sparkSession
    prints = with_fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle)
    prints = materialize(prints.select(F.col(id_col).cast("long").alias("doc_id"), "simhash"), "simhash")
    distinct = materialize(prints.groupBy("simhash").agg(F.min("doc_id").alias("least_id")), "distinct")
    edges = links(distinct.select("simhash", F.col("simhash").alias("rep")), radius=radius, cell_rows=cell_rows).select("src", "dst")
    same_id = prints.groupBy("doc_id").agg(F.min("simhash").alias("one"), F.max("simhash").alias("other")).filter("doc_id IS NOT NULL AND one <> other")
    extra = prints.join(same_id, "doc_id").filter("simhash <> one").select(F.col("simhash").alias("src"), F.col("one").alias("dst"))
    components = connected_components(edges.unionByName(extra))
    grouped = distinct.join(components, distinct["simhash"] == components["vertex"], "left").select("simhash", "least_id", F.coalesce("component", "simhash").alias("component"))
    least = grouped.groupBy("component").agg(F.min("least_id").alias("component_id"))
    classes = materialize(grouped.join(least, "component").select("simhash", "component_id"), "classes")
    for df in (distinct, components):
        remove(spark, df)
    return prints.join(classes, "simhash").select(F.col("doc_id").alias(id_col), "simhash", "component_id")


def with_proposals(docs: DataFrame, *, text_col: str = "text", shingle: int = 2, seed: int = SEED, words: int = 16) -> DataFrame:
    """``docs`` without its text, with ``copy`` (128 bits that name the word sequence) and ``sketch``,
    ``words`` independent fingerprints of the ``shingle``-word shingles as an array of longs."""
    keep = docs.drop("copy", "sketch")
    position = keep.columns.index(text_col)
    others = [c for c in keep.columns if c != text_col]
    schema = keep.select(*others, F.lit("").cast("binary").alias("copy"), F.array(F.lit(0).cast("long")).alias("sketch")).schema

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, prints = [], [np.zeros((0, words), np.uint64)]
            for _, _, data, offs in runs(batch.column(position)):
                text, at, _, bounds = word_bytes(data, offs)
                ends = at[bounds].tolist()
                names += [xxhash.xxh3_128_digest(text[a:b], seed) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                prints.append(text_fingerprints(data, offs, shingle, seed, words))
            flat = np.concatenate(prints)
            sketch = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * words, pa.int32()), pa.array(np.ascontiguousarray(flat).view(np.int64).ravel()))
            columns = [c for i, c in enumerate(batch.columns) if i != position]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(names, pa.binary()), sketch], names=[*others, "copy", "sketch"])

    bounded_batches(docs.sparkSession)
    return keep.mapInArrow(compute, schema)


def with_shingle_sets(docs: DataFrame, *, text_col: str = "text", shingle: int = 5, seed: int = SEED) -> DataFrame:
    """``docs`` with ``shingles`` in place of its text: the hashes of its distinct ``shingle``-word shingles."""
    keep = docs.drop("shingles")
    position = keep.columns.index(text_col)
    others = [c for c in keep.columns if c != text_col]
    schema = keep.select(*others, F.array(F.lit(0).cast("long")).alias("shingles")).schema

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets: list[np.ndarray] = []
            for _, _, data, offs in runs(batch.column(position)):
                text, at, size, bounds = word_bytes(data, offs)
                begin, end, starts = shingle_spans(at, size, bounds, shingle)
                hashes = span_hashes(text, begin, end, seed).view(np.int64)
                sets += [np.unique(hashes[a:b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
            columns = [c for i, c in enumerate(batch.columns) if i != position]
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int32)
            values = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=[*others, "shingles"])

    bounded_batches(docs.sparkSession)
    return keep.mapInArrow(compute, schema)


def _alike(edges: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(src, dst) of the edges whose ends' shingle sets have a Jaccard similarity of at least ``least``."""
    a = sets.select(F.col("vertex").alias("src"), F.col("shingles").alias("_a"))
    b = sets.select(F.col("vertex").alias("dst"), F.col("shingles").alias("_b"))
    both = F.size(F.array_intersect("_a", "_b"))
    return edges.join(a, "src").join(b, "dst").filter(both >= least * (F.size("_a") + F.size("_b") - both)).select("src", "dst")


def confirmed(edges: DataFrame, sets: DataFrame, least: float, *, known: DataFrame | None = None, few: int = 8, sample: int = 64) -> DataFrame:
    """(vertex, component) of the graph of those ``edges`` (src, dst, bits; each once) that the exact similarity confirms,
    and of ``known`` (vertex, component), what is confirmed already.

    Where there are at most ``few`` edges a vertex, all are judged.  Otherwise each
    component has its lightest edge judged, what these connect is contracted, and
    edges inside a component are not judged at all; then up to ``sample`` edges of each
    component, then all that are left.  The result is the same, and a large group of
    copies costs about one comparison for each text."""
    proven = [] if known is None else [known.select(F.col("vertex").alias("src"), F.col("component").alias("dst"))]

    def contracted(rows: DataFrame, components: DataFrame | None) -> DataFrame:
        for end, name in (("src", "a"), ("dst", "b")):
            if components is None:
                rows = rows.withColumn(name, F.col(end))
            else:
                label = components.select(F.col("vertex").alias(end), F.col("component").alias("_c"))
                rows = rows.join(label, end, "left").withColumn(name, F.coalesce("_c", end)).drop("_c")
        return materialize(rows.filter("a <> b"), "open")

    open_ = contracted(edges, known)
    each = 1
    while True:
        ends = open_.select(F.explode(F.array("a", "b")).alias("v"))
        n_edges = open_.count()
        all_ = each > sample or n_edges <= few * (ends.agg(F.approx_count_distinct("v")).first()[0])
        batch = open_
        if not all_:
            light = F.min(F.struct("bits", "src", "dst")).alias("e")
            sides = open_.select("bits", "src", "dst", F.explode(F.array("a", "b")).alias("v"))
            batch = sides.groupBy("v", F.pmod(F.xxhash64("src", "dst"), F.lit(each))).agg(light).select("e.src", "e.dst").distinct()
            each *= sample
        proven.append(materialize(_alike(batch.select("src", "dst"), sets, least), "proven"))
        joined = proven[0]
        for p in proven[1:]:
            joined = joined.unionByName(p)
        components = connected_components(joined)
        if all_:
            return components
        before, open_ = open_, contracted(open_.select("src", "dst", "bits").join(batch, ["src", "dst"], "left_anti"), components)
        remove(edges.sparkSession, before)


def with_parities(sets: DataFrame) -> DataFrame:
    """(vertex, parity) of ``sets`` (vertex, shingles): PARITY bits as an array of longs, each set if an odd number of the
    shingles fall on it.  Parities differ in no more bits than their sets in shingles."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, n = batch.column(1), batch.num_rows
            bit = lists.flatten().to_numpy(zero_copy_only=False) & (PARITY - 1)
            owner = np.repeat(np.arange(n), lists.value_lengths().to_numpy(zero_copy_only=False))
            odd = (np.bincount(owner * PARITY + bit, minlength=n * PARITY) & 1).astype(np.uint8)
            longs = np.packbits(odd, bitorder="little").view(np.int64)
            parity = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * (PARITY // 64), pa.int32()), pa.array(longs))
            yield pa.RecordBatch.from_arrays([batch.column(0), parity], names=["vertex", "parity"])

    bounded_batches(sets.sparkSession)
    return sets.select("vertex", "shingles").mapInArrow(compute, "vertex long, parity array<long>")


def meeting_sides(prefix: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(smaller, larger): the rows of ``prefix`` (vertex, size, left, shingle, component) by which couples meet, the smaller set's and the larger's,
    with the columns ``shingle``, ``band`` and ``most`` on which they are joined.

    A couple shares at most what is ``left`` from a common shingle on, so the smaller set meets in its first ninth only (for 0.8), and a
    larger one at a place meets certain sizes, which are cut into bands.  Of a shingle and band the smaller sets of the component that has
    ``most`` of them meet other components only.  Those of other components may meet their own, which are no more couples than they
    form with the first; so groups that are connected already are not paired with themselves."""
    share = (least - 1e-9) / (1 + least)
    band = lambda size: F.floor(F.log(size) / float(np.log(1.05)))
    smaller = prefix.filter(F.col("left") >= 2 * F.col("size") * share).withColumn("band", band(F.col("size")))
    held = smaller.groupBy("shingle", "band", "component").count().groupBy("shingle", "band")
    held = held.agg(F.max(F.struct("count", "component"))["component"].alias("main"), (F.count("*") > 1).alias("several"))
    smaller = smaller.join(held.select("shingle", "band", "main"), ["shingle", "band"]).withColumn("most", F.col("component") == F.col("main")).drop("main")
    low = F.greatest(F.lit(1.0), F.ceil(F.col("size") * (least - 1e-9)).cast("double"))
    high = F.least(F.col("size").cast("double"), F.floor(F.col("left") / share - F.col("size") + 1e-6).cast("double"))
    larger = prefix.withColumn("low", low).withColumn("high", high).filter("high >= low")
    larger = larger.withColumn("band", F.explode(F.sequence(band(F.col("low")), band(F.col("high"))))).drop("low", "high").join(held, ["shingle", "band"])
    meets = F.array_compact(F.array(F.when(F.col("component") != F.col("main"), F.lit(True)), F.when(F.col("several"), F.lit(False))))
    return smaller, larger.withColumn("most", F.explode(meets)).drop("main", "several")


def prefix_candidates(sets: DataFrame, sketches: DataFrame, components: DataFrame, least: float, radius: int) -> DataFrame:
    """(src, dst, bits) of all couples of ``sets`` (vertex, shingles) that may have a Jaccard similarity of ``least`` and have a
    fingerprint of ``sketches`` (vertex, sketch) within ``radius`` bits, but lie in different ``components``.

    With shingles ordered from rare to frequent, two sets that are so alike share one of the first
    size - ceil(least * size) + 1 of either; so couples meet in these and nowhere else, and none is left out.
    What a couple shares begins at its first common shingle, so no more can be shared than is left there in the
    shorter rest: couples that lie too far down in either order for ``least`` are no rows, and :func:`meeting_sides` keeps most of them
    from meeting at all.  Nor are couples whose parities differ in more bits than alike sets do in shingles (:func:`with_parities`).
    Shingles of a single set take part in the places only."""
    each = sets.select("vertex", F.size("shingles").alias("size"), F.explode("shingles").alias("shingle"))
    often = each.groupBy("shingle").count()
    ranked = each.join(often, "shingle").groupBy("vertex", "size").agg(F.sort_array(F.collect_list(F.struct("count", "shingle"))).alias("s"))
    # a bound that rounding of least * size cannot raise above the exact one
    first = F.col("size") - F.ceil(F.col("size") * (least - 1e-9)) + 1
    prefix = ranked.select("vertex", "size", F.posexplode(F.slice("s", F.lit(1), first.cast("int"))).alias("place", "p")).filter("p.count > 1")
    prefix = prefix.select("vertex", "size", (F.col("size") - F.col("place")).alias("left"), F.col("p.shingle").alias("shingle"))
    own = components.select("vertex", "component")
    prefix = prefix.join(own, "vertex", "left").withColumn("component", F.coalesce("component", "vertex")).join(sketches.select("vertex", "sketch"), "vertex")
    prefix = materialize(prefix.join(with_parities(sets), "vertex"), "prefixes")
    key = ["shingle", "band", "most"]
    side = lambda df, end: df.select(*key, *[F.col(c).alias(f"{c}_{end}") for c in ("vertex", "size", "left", "component", "sketch", "parity")])
    smaller, larger = meeting_sides(prefix, least)
    both = side(smaller, 1).join(side(larger, 2), key).filter(F.col("component_1") != F.col("component_2"))
    both = both.filter((F.col("size_1") < F.col("size_2")) | ((F.col("size_1") == F.col("size_2")) & (F.col("vertex_1") < F.col("vertex_2"))))
    both = both.filter(F.col("size_1") >= F.col("size_2") * (least - 1e-9))
    shared = (F.col("size_1") + F.col("size_2")) * ((least - 1e-9) / (1 + least))
    both = both.filter(F.least("left_1", "left_2") >= shared)
    differ = lambda name: F.zip_with(f"{name}_1", f"{name}_2", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    both = both.filter(F.aggregate(differ("parity"), F.lit(0), lambda n, x: n + x) <= F.col("size_1") + F.col("size_2") - 2 * shared)
    ends = F.least("vertex_1", "vertex_2").alias("src"), F.greatest("vertex_1", "vertex_2").alias("dst")
    return both.select(*ends, F.array_min(differ("sketch")).alias("bits")).filter(F.col("bits") <= radius).distinct()


def representatives(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8, words: int = 16, proposal: int = 2, radius: int = RADIUS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """One row of each group of near-duplicates in ``docs``, the one with the smallest id (null ids last).

    Two texts are linked if any of ``words`` independent fingerprints of their
    ``proposal``-word shingles lies within ``radius`` bits and their sets of
    ``shingle``-word shingles then have a Jaccard similarity of at least ``least``; a
    group is what links connect.  Of the proposed links of a cell FORESTS spanning
    forests are judged; texts of cells with more links are then compared by the shingles that
    any two alike texts share (:func:`prefix_candidates`), so that none is missed and none is invented.  Equal word sequences (null, empty and blank texts:
    the empty one) are copies.  Rows that agree in every column are one; rows that share an id but
    differ elsewhere, or have none, are rows of their own.  Columns may have any names."""
    spark = docs.sparkSession
    row = row_key(docs)
    keyed = docs.select(F.col(id_col).alias("id"), row.alias("row"), F.col(text_col).cast("string").alias("text"))
    prints = materialize(with_proposals(keyed, shingle=proposal, words=words), "proposals")
    repeated = not prints.groupBy("row").count().filter("count > 1").isEmpty()
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first")
    copies = prints.groupBy("copy").agg(first, F.any_value("sketch").alias("sketch")).withColumn("vertex", F.xxhash64("copy"))
    copies = materialize(copies, "copies")
    texts = keyed.select("row", "text")

    def proposed(parts: DataFrame, forests: int, marks: bool = False) -> DataFrame:
        found = links(parts, radius=radius, cell_rows=cell_rows, forests=forests, marks=marks).filter(F.lit(marks) | (F.col("src") != F.col("dst")))
        pair = found.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "bits")
        return materialize(pair.groupBy("src", "dst").agg(F.min("bits").alias("bits")), "proposed")  # a pair meets in several cells

    def shingle_sets(edges: DataFrame, have: DataFrame | None) -> DataFrame:
        ends = edges.select(F.explode(F.array("src", "dst")).alias("vertex")).distinct()
        ends = ends if have is None else ends.join(have.select("vertex"), "vertex", "left_anti")
        wanted = texts.join(copies.join(ends, "vertex", "left_semi").select("vertex", "first.row"), "row")
        wanted = wanted.dropDuplicates(["vertex"]) if repeated else wanted
        return materialize(with_shingle_sets(wanted.select("vertex", "text"), shingle=shingle), "shingles")

    # the first words join most of a large group of copies; all words then look for what these missed
    word = F.posexplode("sketch").alias("word", "simhash")
    some = proposed(copies.select(F.col("vertex").alias("rep"), F.posexplode(F.slice("sketch", 1, FIRST_WORDS)).alias("word", "simhash")), 1)
    sets = shingle_sets(some, None)
    components = confirmed(some, sets, least)
    spent = [prints, copies, some, sets, components]
    if words > FIRST_WORDS or FORESTS > 1:
        known = copies.join(components, "vertex", "left").withColumn("known", F.coalesce("component", "vertex"))
        every = proposed(known.select(F.col("vertex").alias("rep"), "known", word), FORESTS, True)
        edges, marked = every.filter("src <> dst"), every.filter("src = dst").select(F.col("src").alias("vertex"))
        more = shingle_sets(every, sets)
        components = confirmed(edges, sets.unionByName(more), least, known=components)
        spent += [every, more, components]
        whole = sets.unionByName(more)
        left_out = whole.join(marked, "vertex", "left_semi")
        if not left_out.isEmpty():
            rest = materialize(prefix_candidates(left_out, copies, components, least, radius), "rest")
            components = confirmed(rest, left_out, least, known=components)
            spent += [rest, components]
    # should two word sequences ever share a vertex, only the first is a member of its component
    own = copies.select("first", "copy", "vertex").join(components, "vertex", "left").withColumn("component", F.coalesce("component", "vertex"))
    again = own.groupBy("vertex").agg(F.count("*").alias("n"), F.min("copy").alias("least_copy")).filter("n > 1").select("vertex", "least_copy")
    own = own.join(again, "vertex", "left").withColumn("other", F.when(F.col("copy") > F.col("least_copy"), F.col("copy")))
    kept = materialize(own.groupBy("component", "other").agg(F.min("first").alias("first")).select("first.row"), "kept")
    out = docs.withColumn("_row", row).join(kept.withColumnRenamed("row", "_row"), "_row", "left_semi")
    out = (out.dropDuplicates(["_row"]) if repeated else out).select(*[F.col(f"`{c}`") for c in docs.columns])
    for df in spent:
        remove(spark, df)
    return out


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = near_duplicates(docs)
    return out.select("doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id")
