"""Exact top-k inner products over norm-sorted vectors.

Candidates lie in blocks of descending length.  A rotation by the singular
vectors of the candidates puts most of their length into the first components;
the partial product over these plus the Cauchy-Schwarz bound of the rest
(length of one residual times length of the other) rules candidates out, and the
product of lengths rules out what is left of a block, or a whole block, once a
query has k better ones.  What survives is scored exactly in integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.storage import bounded_batches, materialize, remove

TOP_K, SCALE = 10, 1024
#: Rows of a candidate block and of a query block, fewer where a block of vectors would have more bytes.
CANDIDATE_ROWS, QUERY_ROWS, BLOCK_BYTES = 16_384, 1_024, 8 << 20
#: Ranges of descending length, at most; the driver knows the longest vector of each.  Beyond, a range holds several blocks.
MAX_RANGES = 65_536
#: Ranges searched before floors are raised again: eightfold from one round to the next.
GROWTH = 8
#: Candidates of one pruning step, and the rotated components of the partial product.
STEP, HEAD = 2_048, 16
#: Floating-point bounds are loosened by this share of the product of lengths, so that rounding never rules out a result.
SLACK = 1e-9
LONG = np.iinfo(np.int64)


def integer_vectors(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(``vec_id``, ``v``: floor(scale * x) of each component as double), one row for each row.

    Left out: null ids, vectors that are null or empty, or hold a null or a component that
    is not finite.  A component beyond 64 bits is the largest or smallest long."""
    x = F.col(vector_col)
    finite = F.forall(x, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < float("inf")), F.lit(False)))
    good = df.filter(F.col(id_col).isNotNull() & (F.size(x) > 0) & finite)
    v = F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("long"))
    return good.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def rotation(vectors: DataFrame, dims: int) -> np.ndarray:
    """Right singular vectors of all rows, from their dims x dims Gram matrix (summed by task, then by cell)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((dims, dims))
        for batch in batches:
            m = _matrix(batch.column(0), dims).astype(np.float64)
            gram += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims * dims)), pa.array(gram.ravel())], names=["cell", "x"])

    rows = vectors.select("v").mapInArrow(run, "cell long, x double").groupBy("cell").agg(F.sum("x").alias("x")).toArrow()
    gram = np.zeros(dims * dims)
    gram[rows["cell"].to_numpy()] = rows["x"].to_numpy()
    values, turned = np.linalg.eigh(gram.reshape(dims, dims))
    return turned[:, np.argsort(-values)]


def _blocks(rows: DataFrame, dims: int, size: int) -> DataFrame:
    """Runs of at most ``size`` rows of a partition as (part, block, longest, ids, vectors); ids are couples of ``vec_id`` and ``row``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        ids, parts, held = [], [], 0

        def flush(ids: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
            longest = float(np.sqrt((m.astype(np.float64) ** 2).sum(axis=1).max()))
            row = [part, (part << 32) + seq, longest, ids.astype("<i8").tobytes(), m.astype("<i8").tobytes()]
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=["part", "block", "longest", "ids", "vectors"])

        for batch in batches:
            if not batch.num_rows:
                continue
            ids.append(np.column_stack([batch.column(i).to_numpy() for i in (0, 1)]))
            parts.append(_matrix(batch.column(2), dims))
            held += batch.num_rows
            while held >= size:
                all_ids, m = np.concatenate(ids), np.concatenate(parts)
                yield flush(all_ids[:size], m[:size])
                seq, held = seq + 1, held - size
                ids, parts = [all_ids[size:]], [m[size:]]
        if held:
            yield flush(np.concatenate(ids), np.concatenate(parts))

    return rows.select("vec_id", "row", "v").mapInArrow(run, "part long, block long, longest double, ids binary, vectors binary")


class Best:
    """The k best (score, smaller id first) of each query so far; ``scored`` counts the exact products that were needed."""

    def __init__(self, queries: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor.copy()
        self.query, self.id, self.row, self.score = (np.zeros(0, np.int64) for _ in range(4))
        self.queries, self.scored = queries, 0

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """``ids`` are couples of id and row number."""
        query, score = np.concatenate((self.query, query)), np.concatenate((self.score, score))
        id_, row = np.concatenate((self.id, ids[:, 0])), np.concatenate((self.row, ids[:, 1]))
        order = np.lexsort((row, id_, ~score, query))  # ~x falls as x rises, also for the smallest long
        query, id_, row, score = query[order], id_[order], row[order], score[order]
        first = np.searchsorted(query, np.arange(self.queries))
        rank = np.arange(len(query)) - first[query]
        keep = rank < self.k
        last = rank == self.k - 1
        self.floor[query[last]] = np.maximum(self.floor[query[last]], score[last])
        self.query, self.id, self.row, self.score = query[keep], id_[keep], row[keep], score[keep]


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of rows as longs; those beyond 64 bits are the largest or smallest long."""
    bound = np.abs(q.astype(np.float64)).max(axis=1, initial=0) * np.abs(c.astype(np.float64)).sum(axis=1)
    out = np.einsum("ij,ij->i", q, c)
    for k in np.flatnonzero(bound >= 2.0**62):
        out[k] = min(LONG.max, max(LONG.min, sum(a * b for a, b in zip(q[k].tolist(), c[k].tolist(), strict=True))))
    return out


def search_block(qid: np.ndarray, q: np.ndarray, floor: np.ndarray, cid: np.ndarray, c: np.ndarray, turn: np.ndarray, k: int = TOP_K, head: int = HEAD) -> Best:
    """The k best candidates of a block for each query, scores below ``floor`` left out.

    Candidates are in order of descending length; ``qid`` and ``cid`` are couples of id and row
    number, and a query does not meet its own row."""
    best = Best(len(qid), k, floor)
    qf, cf = q.astype(np.float64), c.astype(np.float64)
    qr, cr = qf @ turn, cf @ turn
    q_len, c_len = np.sqrt((qf**2).sum(axis=1)), np.sqrt((cf**2).sum(axis=1))
    q_rest, c_rest = np.sqrt((qr[:, head:] ** 2).sum(axis=1)), np.sqrt((cr[:, head:] ** 2).sum(axis=1))
    exact_in_float = (q_len.max(initial=0) + 1) * (c_len.max(initial=0) + 1) < 2**52
    live = np.arange(len(qid))
    for a in range(0, len(cid), STEP):
        b = min(len(cid), a + STEP)
        slack = SLACK * q_len * c_len[a] + 1e-6
        live = live[q_len[live] * c_len[a] + slack[live] >= best.floor[live]]  # later candidates are no longer
        if not len(live):
            break
        bound = qr[live, :head] @ cr[a:b, :head].T + q_rest[live, None] * c_rest[None, a:b]
        row, col = np.nonzero(bound >= (best.floor[live] - slack[live])[:, None])
        best.scored += len(row)
        if 4 * len(row) >= bound.size and exact_in_float:  # little was ruled out: one product of matrices
            score = np.rint(qf[live] @ cf[a:b].T).astype(np.int64)[row, col]
        else:
            score = np.concatenate([np.zeros(0, np.int64), *[products(q[live[row[s : s + 65536]]], c[a + col[s : s + 65536]]) for s in range(0, len(row), 65536)]])
        keep = (score >= best.floor[live[row]]) & (qid[live[row], 1] != cid[a + col, 1])
        best.add(live[row[keep]], cid[a + col[keep]], score[keep])
    return best


def top_inner_products(vectors: DataFrame, is_query, *, k: int = TOP_K, candidate_rows: int = CANDIDATE_ROWS, query_rows: int = QUERY_ROWS, head: int = HEAD, growth: int = GROWTH) -> DataFrame:
    """(``query_id, rank, vec_id, score``): the k highest integer inner products of each query.

    ``vectors`` are rows of :func:`integer_vectors`; ``is_query`` picks the queries, the
    candidates of a query are all rows of its length but itself, rows that repeat its id included.
    Ties go to the smaller id; with fewer than k candidates all are returned; a query without any
    has no row.  Rows that repeat a query's id are queries of their own.

    Candidates are sorted into ranges of descending length.  The longest block, whose size is
    bounded, is broadcast and gives every query a floor; further ranges are searched in rounds, each
    ``growth`` times as many, and a block of queries meets only the ranges whose longest vector can
    still reach its lowest floor, so most are never met where lengths differ."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    length = F.aggregate("v", F.lit(0.0), lambda s, e: s + e.cast("double") * e)
    rows = materialize(vectors.withColumns({"len2": length, "dims": F.size("v"), "row": F.monotonically_increasing_id()}), "vectors")
    out = None
    for dims, n in rows.groupBy("dims").count().orderBy("dims").collect():  # vectors of one length at a time
        part = _top(rows.filter(F.col("dims") == dims), is_query, n, dims, k, candidate_rows, query_rows, head, growth)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long") if out is None else out


def _top(rows: DataFrame, is_query, n: int, dims: int, k: int, candidate_rows: int, query_rows: int, head: int, growth: int) -> DataFrame:
    spark = rows.sparkSession
    turn = rotation(rows, dims)
    candidate_rows, query_rows = (max(1, min(r, BLOCK_BYTES // (8 * dims))) for r in (candidate_rows, query_rows))
    ranges = min(MAX_RANGES, max(1, -(-n // candidate_rows)))
    ordered = rows.repartitionByRange(ranges, F.desc("len2"), "vec_id").sortWithinPartitions(F.desc("len2"), "vec_id")
    candidates = materialize(_blocks(ordered, dims, candidate_rows), "candidates")
    queries = rows.filter(is_query)
    queries = materialize(_blocks(queries.repartition(max(1, -(-n // (100 * query_rows)))), dims, query_rows), "queries")
    reach = candidates.groupBy("part").agg(F.max("longest").alias("longest")).toArrow().sort_by("part")  # a row a range
    first = candidates.orderBy("block").limit(1).select("block", "ids", "vectors").toArrow()  # one block
    opening = (first["block"][0].as_py(), *(np.frombuffer(first[c][0].as_py(), "<i8") for c in ("ids", "vectors"))) if first.num_rows else None
    shared = spark.sparkContext.broadcast((turn, opening))
    result = "query_id long, query_row long, vec_id long, row long, score long"

    def found(best: Best, qid: np.ndarray) -> pa.RecordBatch:
        columns = [qid[best.query, 0], qid[best.query, 1], best.id, best.row, best.score]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=["query_id", "query_row", "vec_id", "row", "score"])

    def vectors_of(ids: bytes | np.ndarray, v: bytes | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, v = (np.frombuffer(x, "<i8") if isinstance(x, bytes) else x for x in (ids, v))
        return ids.reshape(-1, 2), v.reshape(-1, dims)

    def open_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, (_, cid, c) = shared.value
        for batch in batches:
            for r in range(batch.num_rows):
                qid, q = vectors_of(batch.column(0)[r].as_py(), batch.column(1)[r].as_py())
                yield found(search_block(qid, q, np.full(len(qid), -np.inf), *vectors_of(cid, c), turn, k, head), qid)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, (opened, _, _) = shared.value
        for batch in batches:
            for r in range(batch.num_rows):
                qids, qvectors, floor, block, ids, vectors = (batch.column(i)[r].as_py() for i in range(6))
                if block != opened:
                    qid, q = vectors_of(qids, qvectors)
                    yield found(search_block(qid, q, np.frombuffer(floor, "<f8"), *vectors_of(ids, vectors), turn, k, head), qid)

    place = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row"))
    ranked = lambda df: df.withColumn("rank", place).filter(F.col("rank") <= k)
    if opening is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    own = queries.select(F.col("block").alias("qblock"), F.col("ids").alias("qids"), F.col("vectors").alias("qvectors"), F.col("longest").alias("qlongest"))
    running = materialize(own.select("qids", "qvectors").mapInArrow(open_, result), "running")
    parts, longest, low, wide = reach["part"].to_numpy(), reach["longest"].to_numpy(), 0, 1
    while low < len(parts):
        high = min(len(parts), low + wide)
        met = _with_floors(own, running.groupBy("query_row").agg(F.count("*").alias("n"), F.min("score").alias("low")).filter(F.col("n") >= k).select("query_row", "low"))
        met = _ranges_met(met, parts[low:high], longest[low:high])
        pairs = met.join(candidates.select("part", "block", "ids", "vectors"), "part")
        more = pairs.select("qids", "qvectors", "floor", "block", "ids", "vectors").mapInArrow(search, result)
        before, running = running, materialize(ranked(running.unionByName(more)).drop("rank"), "running")
        remove(spark, before)
        low, wide = high, wide * growth
    return ranked(running).select("query_id", "rank", "vec_id", "score")


def _with_floors(own: DataFrame, floors: DataFrame) -> DataFrame:
    """Query blocks with the floors of their queries, and the lowest of them."""

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                q = np.frombuffer(batch.column(1)[r].as_py(), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), batch.column(0)[r].as_py())), pa.array(np.arange(len(q), dtype=np.int32)), pa.array(np.ascontiguousarray(q[:, 1]))], names=["qblock", "place", "query_row"])

    members = own.select("qblock", "qids").mapInArrow(ids, "qblock long, place int, query_row long")
    known = members.join(floors, "query_row", "left").groupBy("qblock").agg(F.sort_array(F.collect_list(F.struct("place", F.col("low").cast("double").alias("low")))).alias("f"))  # a block of queries
    low = F.transform("f", lambda x: F.coalesce(x["low"], F.lit(float("-inf"))))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # scores near 2**63 are rounded as doubles: a floor must not be above its score
            floors = [np.array(x, "<f8") for x in batch.column(1).to_pylist()]
            floors = [np.where(np.abs(x) > 2**52, x - np.abs(x) * 1e-15, x) for x in floors]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in floors], pa.binary()), pa.array([float(x.min()) for x in floors])], names=["qblock", "floor", "lowest"])

    packed = known.select("qblock", low.alias("low")).mapInArrow(pack, "qblock long, floor binary, lowest double")
    return own.join(packed, "qblock")


def _ranges_met(queries: DataFrame, parts: np.ndarray, longest: np.ndarray) -> DataFrame:
    """Each query block once for every range (number, longest vector; lengths descend) that its lowest floor allows."""
    shared = queries.sparkSession.sparkContext.broadcast((parts, np.maximum.accumulate(longest[::-1])[::-1]))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, longest = shared.value
        for batch in batches:
            for block, reach, lowest in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                some = parts[reach * longest * (1 + SLACK) + 1e-6 >= lowest]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), block)), pa.array(some)], names=["qblock", "part"])

    chosen = queries.select("qblock", "qlongest", "lowest").mapInArrow(choose, "qblock long, part long")
    return chosen.join(queries.select("qblock", "qids", "qvectors", "floor"), "qblock")


def op2_topk(spark, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_inner_products(vectors, F.col("vec_id") % 100 == 0)


ORACLE_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), e AS (SELECT r, vec_id, len(v) AS n, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM v
), s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id AS vec_id, c.r AS cr, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM e q JOIN e c ON q.i = c.i AND q.n = c.n AND q.vec_id % 100 = 0 AND q.r <> c.r
  GROUP BY ALL
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id, cr) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id, cr) <= 10
"""
