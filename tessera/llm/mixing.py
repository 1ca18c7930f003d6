"""Mixing sources to target weights by iterative proportional fitting.

Token counts are summed by cell (source, language, topic); the fit scales the
cells until their shares meet the target marginals of all three dimensions, no
cell beyond its tokens; documents are then drawn with their cell's probability.
Topics are clusters of hashed content words: spherical k-means whose every step
is a distributed sum over all documents, in integers, so that neither the order
of rows nor a task that runs again changes a centre.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.storage import bounded_batches, materialize

from .rows import row_key
from .textbytes import runs
from .vocabulary import BYTE_BPE, byte_bpe

#: The class of missing values; every other value of a dimension is a class of its own.
NONE = ""
#: Up to so many cells their rates are broadcast to the documents; beyond, the join is Catalyst's choice.
BROADCAST_CELLS = 100_000
#: Topics, slots that words are hashed to (2**SLOT_BITS), steps of k-means over all documents, and documents among which the first centres are chosen.
TOPICS, SLOT_BITS, TOPIC_STEPS, FIRST_CENTRES = 6, 11, 8, 2_000
SLOTS, LONG_WORD = 1 << SLOT_BITS, 5
#: Whole numbers that stand for 1 in a document's vector and in a centre; products of both stay exact in a double.
UNIT, CENTRE_UNIT = 4095, 1 << 20
FIT_STEPS, TOLERANCE = 200, 1e-9
WORD_BASE = np.uint64(0x9E3779B97F4A7C15)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def word_vectors(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """The vector of each text: little-endian pairs (slot, weight) of 16 bits, by slot.

    Words of LONG_WORD bytes and more are hashed, whole, to slots; weights are square
    roots of a slot's count, scaled to a vector of length UNIT and rounded (to 1 at least)."""
    docs = len(offsets) - 1
    word = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(word & ~(np.concatenate(([False], word[:-1])) & ~edge[:-1]))
    end = np.flatnonzero(word & ~(np.concatenate((word[1:], [False])) & ~edge[1:])) + 1
    doc = np.searchsorted(offsets, start, "right") - 1
    long_ = end - start >= LONG_WORD
    start, end, doc = start[long_], end[long_], doc[long_]
    if not len(start):
        return [b""] * docs
    size = end - start
    begin = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(begin, size)
    power = np.full(int(size.max()), WORD_BASE)
    power[0] = 1
    power = np.multiply.accumulate(power)
    key = np.add.reduceat((data[np.repeat(start, size) + place].astype(np.uint64) + np.uint64(1)) * power[place], begin)
    slot = ((key ^ (key >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - SLOT_BITS)
    cell, count = np.unique(doc * SLOTS + slot.astype(np.int64), return_counts=True)
    own = cell // SLOTS
    bounds = np.searchsorted(own, np.arange(docs + 1))
    words = np.bincount(own, count, docs)
    weight = np.maximum(1, np.rint(UNIT * np.sqrt(count / words[own])))
    pairs = np.stack((cell % SLOTS, weight.astype(np.int64)), axis=1).astype("<u2")
    return [pairs[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def dense(vectors: list[bytes]) -> np.ndarray:
    """(texts, SLOTS) doubles of packed vectors."""
    out = np.zeros((len(vectors), SLOTS))
    pairs = np.frombuffer(b"".join(vectors), "<u2").reshape(-1, 2).astype(np.int64)
    out[np.repeat(np.arange(len(vectors)), [len(v) // 4 for v in vectors]), pairs[:, 0]] = pairs[:, 1]
    return out


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Centre with the largest product for each point, the first of equals; -1 for a point without words."""
    return np.where(points.any(axis=1), (points @ centres.T).argmax(axis=1), -1)


def unit_centres(sums: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Sums of vectors scaled to whole numbers of length CENTRE_UNIT; a centre without points stays."""
    length = np.sqrt((sums.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
    return np.where(length > 0, np.rint(sums * (CENTRE_UNIT / np.maximum(length, 1e-9))), before)


def first_centres(points: np.ndarray, topics: int) -> np.ndarray:
    """The first point, then points drawn in proportion to the square of what they lack in likeness to the nearest centre."""
    points, draws = unit_centres(points, points), np.random.default_rng(0)
    centres = points[:1]
    while len(centres) < topics:
        gap = np.cumsum(np.maximum(0, 1 - (points @ centres.T).max(axis=1) / CENTRE_UNIT**2) ** 2)
        if gap[-1] < 1e-6:
            break
        centres = np.vstack((centres, points[np.searchsorted(gap, draws.random() * gap[-1], "right")]))
    return centres


DENSE_ROWS = 1_024


def topic_centres(vectors: DataFrame, *, topics: int = TOPICS, steps: int = TOPIC_STEPS, first: int = FIRST_CENTRES) -> np.ndarray:
    """(topics, SLOTS) centres of k-means over all rows of ``vectors`` (column ``vector``).

    Only the centres it starts from are chosen among ``first`` documents, those with the
    smallest hashes of their words; every step then sums the vectors of all documents by
    centre, and ends early when no centre moves."""
    some = vectors.filter(F.length("vector") > 0).select("vector")
    n = some.count()
    if not n:
        return np.zeros((1, SLOTS))
    draw, by_hash = F.pmod(F.xxhash64("vector"), F.lit(1 << 30)) / float(1 << 30), F.xxhash64(F.lit("topics"), F.col("vector"))
    for share in (4 * first / n, 1.0):  # some four times as many are enough to choose from, unless nearly all are copies
        start = some.filter(draw < share).distinct().orderBy(by_hash, "vector").limit(first).toArrow()["vector"].to_pylist()
        if len(start) >= min(first, TOPICS):
            break
    centres = first_centres(dense(start), topics)
    for _ in range(steps):
        shared = vectors.sparkSession.sparkContext.broadcast(centres)  # topics x SLOTS

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = np.zeros(shared.value.shape)
            for batch in batches:
                column = batch.column(0).to_pylist()
                for a in range(0, len(column), DENSE_ROWS):
                    points = dense(column[a : a + DENSE_ROWS])
                    near = nearest(points, shared.value)
                    own += (near == np.arange(len(own))[:, None]).astype(np.float64) @ points
            flat = own.ravel()
            at = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at].astype(np.int64))], names=["at", "n"])

        rows = some.mapInArrow(sums, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
        total = np.zeros(centres.size)
        total[rows["at"].to_numpy()] = rows["n"].to_numpy()
        moved = unit_centres(total.reshape(centres.shape), centres)
        if np.array_equal(moved, centres):
            break
        centres = moved
    return centres


def with_vectors(docs: DataFrame, *, text_col: str = "text", vocabulary: str = BYTE_BPE) -> DataFrame:
    """``docs`` without its text, with ``vector`` (see :func:`word_vectors`) and ``tokens``
    (its ids in ``vocabulary``), over whole texts; null text has neither words nor tokens."""
    keep = docs.drop("vector", "tokens")
    position = keep.columns.index(text_col)
    others = [c for c in keep.columns if c != text_col]
    schema = keep.select(*others, F.lit("").cast("binary").alias("vector"), F.lit(0).cast("long").alias("tokens")).schema
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(vocabulary)
        for batch in batches:
            text = batch.column(position)
            vectors = [v for _, _, data, offs in runs(text) for v in word_vectors(data, offs)]
            tokens = [len(bpe.ids(t)) for t in text.to_pylist()]
            columns = [c for i, c in enumerate(batch.columns) if i != position]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(vectors, pa.binary()), pa.array(tokens, pa.int64())], names=[*others, "vector", "tokens"])

    return keep.mapInArrow(run, schema)


def with_topics(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """``vectors`` with ``topic`` (``t0`` and on; ``""`` for texts without a long word) in place of ``vector``."""
    keep = vectors.drop("topic")
    position = keep.columns.index("vector")
    others = [c for c in keep.columns if c != "vector"]
    shared = vectors.sparkSession.sparkContext.broadcast(centres)  # topics x SLOTS
    names = np.array([*[f"t{k}" for k in range(len(centres))], NONE], dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(position).to_pylist()
            near = [nearest(dense(column[a : a + DENSE_ROWS]), shared.value) for a in range(0, len(column), DENSE_ROWS)]
            topic = pa.array(names[np.concatenate(near)] if near else [], pa.string())
            yield pa.RecordBatch.from_arrays([*[c for i, c in enumerate(batch.columns) if i != position], topic], names=[*others, "topic"])

    return keep.mapInArrow(run, keep.select(*others, F.lit("").alias("topic")).schema)


@dataclass(frozen=True)
class Fit:
    """Kept tokens of each cell, and how far the marginals are from their targets (largest share missed)."""

    kept: np.ndarray
    missed: float
    steps: int


def rake(tokens: np.ndarray, members: list[np.ndarray], targets: list[np.ndarray], budget: float) -> Fit:
    """Scale ``tokens`` of cells until the sums over ``members`` (class of each cell, by
    dimension) are ``budget`` times ``targets`` (shares of the classes).

    Cells stay within their tokens: a class that cannot meet its target keeps all it
    has, and the rest of the budget goes to the other classes in proportion."""
    tokens = tokens.astype(np.float64)
    budget = min(budget, tokens.sum())
    kept = tokens * (budget / max(tokens.sum(), 1e-300))
    goals = []
    for group, share in zip(members, targets, strict=True):
        available = np.bincount(group, tokens, minlength=len(share))
        goal, open_ = np.zeros(len(share)), share > 0
        left = budget
        while left > 0 and open_.any():  # what some classes cannot give is asked of the others
            want = left * share / share[open_].sum()
            full = open_ & (want >= available)
            if not full.any():
                goal[open_] = want[open_]
                break
            goal[full] = available[full]
            left -= available[full].sum()
            open_ &= ~full
        goals.append(goal)
    steps, missed = 0, 0.0
    for steps in range(1, FIT_STEPS + 1):
        missed = 0.0
        for group, goal in zip(members, goals, strict=True):
            have = np.bincount(group, kept, minlength=len(goal))
            missed = max(missed, float(np.abs(have - goal).max(initial=0) / max(budget, 1e-300)))
            kept = np.minimum(tokens, kept * np.divide(goal, have, out=np.zeros_like(goal), where=have > 0)[group])
        if missed < TOLERANCE:
            break
    return Fit(kept, missed, steps)


def tempered(tokens: dict[str, float], power: float) -> dict[str, float]:
    """Shares in proportion to tokens to the ``power``: 1 keeps the mixture, 0 makes it even."""
    raised = {k: v**power if v > 0 else 0.0 for k, v in tokens.items()}
    total = sum(raised.values()) or 1.0
    return {k: v / total for k, v in raised.items()}


def mixing_rates(rows: DataFrame, *, targets: dict[str, dict[str, float]] | None = None, power: float = 0.7, keep_share: float = 0.5) -> DataFrame:
    """``rows`` (``source, lang, topic, tokens``) with their classes, the calibrated
    ``probability`` of their cell, ``weight``, the factor that restores expected token
    counts by cell (0 for cells that get nothing), and ``missed``, the largest share of
    the kept tokens by which a class stays off what it can get.

    ``targets`` gives shares by dimension and class, in any scale; a dimension without is
    tempered by ``power``.  Classes that targets do not name get nothing; of those they
    name, classes that do not occur leave their share to the others.  Every source and
    language is a class (null: ``""``); the driver fits the cells (source, language, topic)
    that occur, as Arrow and NumPy columns."""
    spark = rows.sparkSession
    dims = ["source", "lang", "topic"]
    classes = [f"{d}_class" for d in dims]
    rows = rows.withColumns({f"{d}_class": F.coalesce(F.col(d), F.lit(NONE)) for d in dims})
    cells = rows.groupBy(*classes).agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")).toArrow().sort_by([(c, "ascending") for c in classes])
    tokens = cells["tokens"].to_numpy().astype(np.float64)
    members, shares = [], []
    for d, name in zip(dims, classes, strict=True):
        coded = cells[name].combine_chunks().dictionary_encode()
        values, group = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
        sums = dict(zip(values, np.bincount(group, tokens, minlength=len(values)).tolist(), strict=True))
        wanted = (targets or {}).get(d) or tempered(sums, power)
        share = np.array([max(0.0, wanted.get(v, 0.0)) for v in values])
        members.append(group)
        shares.append(share / share.sum() if share.sum() else share)
    fit = rake(tokens, members, shares, keep_share * tokens.sum())
    rate = np.divide(fit.kept, tokens, out=np.zeros(len(tokens)), where=tokens > 0)
    rates = spark.createDataFrame(cells.select(classes).append_column("probability", pa.array(rate)))
    out = rows.join(F.broadcast(rates) if len(rate) <= BROADCAST_CELLS else rates, classes, "left")
    # a document without a token weighs nothing in any cell: it goes with the share that is kept
    out = out.withColumn("probability", F.when(F.col("tokens") > 0, F.col("probability")).otherwise(F.lit(float(keep_share))))
    return out.withColumn("weight", F.when(F.col("probability") > 0, 1 / F.col("probability")).otherwise(0.0)).withColumn("missed", F.lit(fit.missed))


def drawn(probability: Column, name: Column, *, seed: int = 0) -> Column:
    """Whether a document is drawn: a hash of seed and name, uniform in [0, 1), below its probability."""
    uniform = F.shiftrightunsigned(F.xxhash64(F.lit(seed), name), 11) / float(1 << 53)
    return uniform < probability


def rated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", targets: dict[str, dict[str, float]] | None = None, power: float = 0.7, keep_share: float = 0.5, seed: int = 0, vocabulary: str = BYTE_BPE) -> DataFrame:
    """A row for each document: ``row`` (:func:`row_key`), ``doc_id, source, lang, topic, tokens, probability, weight, missed, kept``.

    ``docs`` needs ``source`` and ``lang``.  Null and empty sources and languages are a class of
    their own.  Null and empty texts have no tokens and are drawn at the share that is kept.
    Rows that repeat an id are drawn together, rows without one by all their columns."""
    text = [F.col(text_col).cast("string").alias("text"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang")]
    rows = docs.select(F.col(id_col).alias("doc_id"), row_key(docs).alias("row"), *text)
    vectors = materialize(with_vectors(rows, vocabulary=vocabulary), "vectors")
    topics = with_topics(vectors, topic_centres(vectors))
    rates = mixing_rates(topics, targets=targets, power=power, keep_share=keep_share)
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat_ws(" ", F.lit("row"), "row.a", "row.b"))
    return rates.select("row", "doc_id", "source", "lang", "topic", "tokens", "probability", "weight", "missed", drawn(F.col("probability"), name, seed=seed).alias("kept"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The drawn documents of :func:`rated`: ``doc_id, source, lang, topic, tokens, probability, weight, missed``.  An empty table gives an empty one."""
    return rated(docs, **options).filter("kept").drop("row", "kept")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that :func:`rated` draws, as they are."""
    kept = rated(docs, **options).filter("kept").select(F.col("row").alias("_row")).distinct()
    return docs.withColumn("_row", row_key(docs)).join(kept, "_row", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
