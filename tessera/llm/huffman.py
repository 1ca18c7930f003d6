"""Token ids as canonical length-limited Huffman code, in blocks that decode on their own.

The file format is a directory with two Parquet tables.  ``codebook`` holds the
code length of every id (canonical codes follow from the lengths).  ``blocks``
holds, in ascending order of documents, ``shard, block``, the documents' ids and
token counts, the packed code bits, and ``checkpoints``: the bit offset of every
STRIDE-th token, so that decoding can begin at any of them.  A block reads back
with the codebook alone; all its strides advance side by side, a table look-up
for each step.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.storage import bounded_batches, materialize, remove, shared_path

from .vocabulary import BYTE_BPE, byte_bpe

MAX_BITS, STRIDE, BLOCK_TOKENS, END_ID = 20, 64, 1 << 18, 0
BLOCKS = "shard int, block int, n_tokens long, doc_ids binary, doc_tokens binary, payload binary, checkpoints binary"


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``max_bits`` (package-merge); 0 for ids that never occur."""
    lengths = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    n = len(used)
    if n == 0:
        return lengths
    if n == 1:
        lengths[used] = 1
        return lengths
    if n > 1 << max_bits:
        raise ValueError("more ids than codes")
    order = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[order].astype(np.float64)
    # weights[l]: leaves and packages of level l, sorted; is_leaf tells them apart
    weights, kinds = leaf, [np.ones(n, bool)]
    for _ in range(max_bits - 1):
        pairs = weights[: len(weights) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate((leaf, pairs))
        place = np.argsort(both, kind="stable")
        weights = both[place]
        kinds.append(place < n)
    take = 2 * n - 2
    depth = np.zeros(n, np.int64)
    for is_leaf in reversed(kinds):
        leaves = int(is_leaf[:take].sum())
        depth[:leaves] += 1
        take = 2 * (take - leaves)
    lengths[order] = depth
    return lengths


@dataclass(frozen=True)
class Code:
    """Canonical codes by length, then id; ``symbol``/``bits`` are the decoding table over ``width`` bits."""

    lengths: np.ndarray
    codes: np.ndarray
    symbol: np.ndarray
    bits: np.ndarray
    width: int

    @staticmethod
    def of(lengths: np.ndarray) -> Code:
        width = max(1, int(lengths.max(initial=0)))
        used = np.flatnonzero(lengths)
        order = used[np.lexsort((used, lengths[used]))]
        span = np.int64(1) << (width - lengths[order])  # entries of the table that a code fills
        first = np.cumsum(span) - span
        codes = np.zeros(len(lengths), np.uint64)
        codes[order] = (first >> (width - lengths[order])).astype(np.uint64)
        symbol, bits = np.zeros(1 << width, np.uint32), np.zeros(1 << width, np.uint8)
        end = int(span.sum())
        symbol[:end], bits[:end] = np.repeat(order, span), np.repeat(lengths[order], span)
        return Code(lengths, codes, symbol, bits, width)


def encode_block(code: Code, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(packed bits, bit offset of every STRIDE-th id)."""
    size = code.lengths[ids]
    at = np.cumsum(size) - size
    words = np.zeros((int(at[-1] + size[-1]) >> 5) + 3 if len(ids) else 2, np.uint64)
    if len(ids):
        value = code.codes[ids] << (64 - size - (at & 31)).astype(np.uint64)
        slot = at >> 5
        high, low = value >> np.uint64(32), value & np.uint64(0xFFFFFFFF)
        # codes do not overlap, so sums are unions; below 2**53 they are exact
        words[: slot[-1] + 1] += np.bincount(slot, high.astype(np.float64)).astype(np.uint64)
        words[1 : slot[-1] + 2] += np.bincount(slot, low.astype(np.float64)).astype(np.uint64)
    return words.astype(">u4").tobytes(), at[::STRIDE].astype(np.int64)


def decode_block(code: Code, payload: bytes, checkpoints: np.ndarray, n_tokens: int) -> np.ndarray:
    """All ids of a block: every stride is a lane, each step decodes one id in all of them."""
    words = np.frombuffer(payload, dtype=">u4").astype(np.uint64)
    pairs = (words[:-1] << np.uint64(32)) | words[1:]
    lanes = len(checkpoints)
    out = np.zeros((STRIDE, lanes), np.uint32)
    at = checkpoints.astype(np.int64).copy()
    shift, mask = 64 - code.width, np.uint64((1 << code.width) - 1)
    last = n_tokens - (lanes - 1) * STRIDE
    for step in range(min(STRIDE, n_tokens)):
        live = lanes if step < last else lanes - 1
        now = at[:live]
        peek = (pairs[now >> 5] >> (shift - (now & 31)).astype(np.uint64)) & mask
        out[step, :live] = code.symbol[peek]
        now += code.bits[peek]
    return out.T.ravel()[:n_tokens]


def token_table(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = BYTE_BPE, end_id: int | None = END_ID) -> DataFrame:
    """(``doc_id``, ``n_tokens``, ``ids``): little-endian 16- or 32-bit ids, compressed, of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, pack = byte_bpe(vocabulary), zstandard.ZstdCompressor(level=1)
        kind = np.uint16 if bpe.size <= 1 << 16 else np.uint32
        for batch in batches:
            sizes, blobs = [], []
            for text in batch.column(1).to_pylist():
                ids = bpe.ids(text, end_id)
                sizes.append(len(ids))
                blobs.append(pack.compress(ids.astype(kind).tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(blobs, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def unpack_ids(blob: bytes, n_tokens: int) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    return np.frombuffer(raw, dtype=np.uint16 if len(raw) == 2 * n_tokens else np.uint32).astype(np.uint32)


def global_counts(tokens: DataFrame, size: int) -> np.ndarray:
    """Occurrences of every id over the whole table: counted by task, summed by id; the vocabulary bounds the answer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for batch in batches:
            for n, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                np.add.at(counts, unpack_ids(blob, n), 1)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["id", "n"])

    rows = tokens.select("n_tokens", "ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(size, np.int64)
    counts[rows["id"].to_numpy()] = rows["n"].to_numpy()
    return counts


def write_tokens(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = BYTE_BPE, max_bits: int = MAX_BITS, end_id: int | None = END_ID) -> None:
    """Encode whole texts (null: empty), each with ``end_id`` appended, and write them in ascending order of ids.

    Texts are tokenized once; the compressed ids are kept in the shared folder
    for counting and for the range shuffle by id.  Rows that repeat an id lie
    side by side, ordered by their ids' bytes; null ids come first.  No document
    larger than a block is cut: a block ends with the document that fills it."""
    spark = docs.sparkSession
    bounded_batches(spark)
    tokens = materialize(token_table(docs, id_col=id_col, text_col=text_col, vocabulary=vocabulary, end_id=end_id), "tokens")
    lengths = code_lengths(global_counts(tokens, byte_bpe(vocabulary).size), max_bits)
    used = np.flatnonzero(lengths)
    book = spark.createDataFrame([(int(i), int(lengths[i])) for i in used], "id int, bits int")
    book.coalesce(1).write.parquet(f"{path}/codebook")
    shared = spark.sparkContext.broadcast(lengths.astype(np.uint8))  # a byte for each id of the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        code, shard, block = Code.of(shared.value.astype(np.int64)), TaskContext.get().partitionId(), 0
        docs, sizes, parts, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(parts)
            payload, checkpoints = encode_block(code, ids)
            ids_of = np.array([(0 if d is None else d, d is not None) for d in docs], dtype=[("id", "<i8"), ("known", "<i1")])
            row = [shard, block, len(ids), ids_of.tobytes(), np.array(sizes, "<i8").tobytes(), payload, checkpoints.astype("<i8").tobytes()]
            kinds = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 4]
            names = ["shard", "block", "n_tokens", "doc_ids", "doc_tokens", "payload", "checkpoints"]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=names)

        for batch in batches:
            for doc, n, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                docs.append(doc)
                sizes.append(n)
                parts.append(unpack_ids(blob, n))
                held += n
                if held >= BLOCK_TOKENS:
                    yield flush()
                    docs, sizes, parts, held, block = [], [], [], 0, block + 1
        if docs:
            yield flush()

    shards = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = tokens.repartitionByRange(shards, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids")
    ordered.mapInArrow(run, BLOCKS).write.parquet(f"{path}/blocks")
    remove(spark, tokens)


def read_codebook(spark: SparkSession, path: str, size: int) -> np.ndarray:
    rows = spark.read.schema("id int, bits int").parquet(f"{path}/codebook").toArrow()
    lengths = np.zeros(size, np.int64)
    lengths[rows["id"].to_numpy()] = rows["bits"].to_numpy()
    return lengths


def read_tokens(spark: SparkSession, path: str, per_document, schema: str, *, vocabulary: str = BYTE_BPE) -> DataFrame:
    """Decode every block and hand each document to ``per_document(ids) -> tuple``.

    Returns ``shard, block, place`` (in the block), ``doc_id, n_tokens, start`` (ids
    before it in its block) and the columns of ``schema``."""
    lengths = spark.sparkContext.broadcast(read_codebook(spark, path, byte_bpe(vocabulary).size).astype(np.uint8))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code.of(lengths.value.astype(np.int64))
        for batch in batches:
            for shard, block, n, doc_ids, doc_tokens, payload, checkpoints in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                ids = decode_block(code, payload, np.frombuffer(checkpoints, "<i8"), n)
                docs, sizes = np.frombuffer(doc_ids, dtype=[("id", "<i8"), ("known", "<i1")]), np.frombuffer(doc_tokens, "<i8")
                starts = np.cumsum(sizes) - sizes
                found = list(zip(*(per_document(ids[a : a + k]) for a, k in zip(starts, sizes, strict=True)), strict=True))
                head = [pa.array(np.full(len(docs), shard, np.int32)), pa.array(np.full(len(docs), block, np.int32)), pa.array(np.arange(len(docs), dtype=np.int32)), pa.array(docs["id"], mask=docs["known"] == 0), pa.array(sizes), pa.array(starts)]
                yield pa.RecordBatch.from_arrays([*head, *(pa.array(list(x), t) for x, t in zip(found, kinds, strict=True))], names=names)

    out = f"shard int, block int, place int, doc_id long, n_tokens long, start long, {schema}"
    wanted = spark.createDataFrame([], out).schema
    from pyspark.sql.pandas.types import to_arrow_type

    kinds, names = [to_arrow_type(f.dataType) for f in wanted.fields[6:]], wanted.names
    return spark.read.schema(BLOCKS).parquet(f"{path}/blocks").mapInArrow(run, wanted)


def with_global_start(spark: SparkSession, decoded: DataFrame, path: str) -> DataFrame:
    """``start`` counted from the first document of the first shard instead of the block's."""
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").select("shard", "block", "n_tokens")
    before_block = F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    shards = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect()  # a row for each output file
    total, base = 0, {}
    for shard, n in sorted(shards):
        base[shard] = total
        total += n
    bases = spark.createDataFrame(list(base.items()), "shard int, base long")
    offsets = blocks.select("shard", "block", F.coalesce(before_block, F.lit(0)).alias("before")).join(bases, "shard")
    offsets = offsets.select("shard", "block", (F.col("before") + F.col("base")).alias("_base"))
    return decoded.join(offsets, ["shard", "block"]).withColumn("start", F.col("start") + F.col("_base")).drop("_base")


def _crc(ids: np.ndarray) -> tuple[int]:
    return (zlib.crc32(ids.astype("<u4").tobytes()),)


def op6_huffman_tokens(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = shared_path(spark, "huffman")
    write_tokens(docs, path)
    out = with_global_start(spark, read_tokens(spark, path, _crc, "ids_crc32 long"), path)
    return out.select("doc_id", "start", "n_tokens", "ids_crc32")
