"""Packing of documents into sequences of bounded length.

Pieces of equal length are interchangeable, so best fit over the whole corpus needs
only the number of pieces of each length: the driver plans whole ranges of equal
sequences from that histogram, whose size follows the sequence length alone.
Every piece then finds its place by its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.storage import bounded_batches, materialize

from .vocabulary import BYTE_BPE, byte_bpe

SEQUENCE, END_ID = 1024, 2

def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit, longest first: (bin of each item, its offset there, fill of each bin).

    An item goes to the fullest bin that still holds it, else to a new one.  Open
    bins are kept by free space; a bit mask of the spaces in use finds the
    tightest in constant time.  Equal items are placed in input order."""
    order = np.argsort(-sizes, kind="stable")
    where, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    free: list[int] = []
    by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    spaces = 0
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fitting = spaces >> size
        if fitting:
            space = size + (fitting & -fitting).bit_length() - 1
            b = by_space[space].pop()
            if not by_space[space]:
                spaces &= ~(1 << space)
        else:
            space, b = capacity, len(free)
            free.append(capacity)
        where[i], offset[i] = b, capacity - space
        left = free[b] = space - size
        if left:
            by_space[left].append(b)
            spaces |= 1 << left
    return where, offset, capacity - np.array(free, dtype=np.int64)


def cut(n_tokens: int, capacity: int = SEQUENCE) -> list[int]:
    """Lengths of a document's pieces: full ones, the first one shorter if need be."""
    first = n_tokens % capacity
    return ([first] if first else []) + [capacity] * (n_tokens // capacity)


def plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Best fit, longest first, of ``counts[length]`` pieces: rows (length, first rank, first sequence, offset).

    From its first rank on, up to the next row of its length, the piece of rank
    ``first rank + i`` lies in ``first sequence + i`` at ``offset``.  Needs as many
    sequences as :func:`best_fit` of all pieces; ranges of sequences with equal free
    space are handled at once, so work does not grow with the pieces."""
    by_space: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # (first sequence, how many)
    spaces, sequences, out = 0, 0, []
    for size in sorted((n for n, c in counts.items() if c), reverse=True):
        rank, left = 0, counts[size]
        while left:
            fitting = spaces >> size
            if fitting:
                space = size + (fitting & -fitting).bit_length() - 1
                first, many = by_space[space].pop()
                each = space // size  # the tightest place stays the tightest until it is full
            else:
                space, each = capacity, capacity // size
                first, many = sequences, max(1, left // each)
                sequences += many
            take = min(many, left // each)
            if not take:
                take, each = 1, left
            for i in range(each):
                out.append((size, rank + i * take, first, capacity - space + i * size))
            rank, left = rank + each * take, left - each * take
            if many > take:
                by_space[space].append((first + take, many - take))
            if rest := space - each * size:
                by_space[rest].append((first, take))
                spaces |= 1 << rest
            if not by_space[space]:
                spaces &= ~(1 << space)
    return np.array(out, np.int64).reshape(-1, 4)


def _pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int) -> DataFrame:
    """Every piece with its partition (``leaf``) and its rank among the pieces of its length there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bpe, leaf, seen = byte_bpe(vocabulary), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = bpe.ids(text, end_id)
                data, start = ids.astype("<u4").tobytes(), 0
                for piece, length in enumerate(cut(len(ids), capacity)):
                    rows.append((doc, piece, start, length, zlib.crc32(data[4 * start : 4 * (start + length)]), seen[length]))
                    seen[length] += 1
                    start += length
            if rows:
                doc, piece, start, length, crc, rank = zip(*rows, strict=True)
                columns = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(rank, pa.int64()), pa.array([leaf] * len(rows), pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "rank", "leaf"])

    return docs.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, rank long, leaf int")


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = BYTE_BPE, end_id: int = END_ID, capacity: int = SEQUENCE) -> DataFrame:
    """A row for each piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A document is its token ids (null text: none) and ``end_id``; only documents
    longer than ``capacity`` are cut, their first piece taking the remainder.
    Pieces of a sequence lie gapless from 0.  Rows that repeat an id, or have
    none, are documents of their own; an empty table gives an empty one.  There are as
    many sequences as best fit of all pieces needs, however they are partitioned."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = materialize(_pieces(rows, vocabulary, end_id, capacity), "pieces")
    per_leaf = pieces.groupBy("length", "leaf").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in per_leaf.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # one row a length
    shared = spark.sparkContext.broadcast(plan(counts, capacity))
    before = Window.partitionBy("length").orderBy("leaf").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_leaf.select("length", "leaf", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        placed = shared.value[np.lexsort((shared.value[:, 1], shared.value[:, 0]))]
        key = (placed[:, 0] << 48) + placed[:, 1]
        for batch in batches:
            rank = batch.column(5).to_numpy()
            at = np.searchsorted(key, (batch.column(3).to_numpy() << 48) + rank, "right") - 1
            sequence = placed[at, 2] + rank - placed[at, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(placed[at, 3])], names=[*columns, "sequence_id", "offset"])

    ranked = pieces.join(bases, ["length", "leaf"]).select(*columns, (F.col("rank") + F.col("base")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op5_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
