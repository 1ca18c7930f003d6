"""Document fingerprints by winnowing, in DataFrame expressions only.

A text's words (runs outside space and tab to carriage return, lower-cased) are
hashed; k-gram hashes roll by rotation and XOR, built by doubling so that each
step is one pass over the array.  Of every ``window`` consecutive k-gram hashes
the minimum is kept, the rightmost of equals, with its position: any run of
``window + k - 1`` words that two texts share gives them a hash in common.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.ranges import quantile_bounds, range_number

K, WINDOW = 5, 4
WORD_SPLIT = r"[\x20\x09-\x0D]+"
#: Documents in a range of ids that one window task sorts; ranges are at most MAX_RANGES, beyond that they hold more (and sort on disk).
RANGE_ROWS, MAX_RANGES = 2048, 65_536


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), WORD_SPLIT), "")


def _rotate(x: Column, by: int) -> Column:
    return F.shiftleft(x, by).bitwiseOR(F.shiftrightunsigned(x, 64 - by))


def _join(a: Column, b: Column, shift: int, f) -> Column:
    """f over a[i] and b[i + shift], for as long as both exist."""
    n = F.least(F.size(a), F.size(b) - shift)
    n = F.greatest(n, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1 + shift), n), f)


def _rolled(by: int):
    """Joins the hash of a left part with that of the ``by`` words to its right."""
    return lambda a, b: _rotate(a, by).bitwiseXOR(b)


def winnow_columns(df: DataFrame, text: Column, name: str, *, k: int = K, window: int = WINDOW) -> DataFrame:
    """``df`` with ``name``: array<struct<hash: long, position: int>> of the selected k-grams, in text order.

    Fewer words than ``k`` make one k-gram of all; no word (null, empty, blank)
    gives an empty array.  Fewer k-grams than ``window`` make one window.
    Positions count k-grams from 0.  Equal texts get equal arrays."""
    t = f"_{name}"
    df = df.withColumn(f"{t}w", F.transform(words(text), lambda w: F.xxhash64(w)))
    powers = {1: F.col(f"{t}w")}
    have = 1
    while 2 * have <= k:
        df = df.withColumn(f"{t}g{2 * have}", _join(powers[have], powers[have], have, _rolled(have)))
        powers[2 * have] = F.col(f"{t}g{2 * have}")
        have *= 2
    grams, rest = powers[have], k - have
    for size in sorted(powers, reverse=True):  # the remaining binary digits of k
        if rest >= size:
            grams = _join(grams, powers[size], k - rest, _rolled(size))
            rest -= size
    n_words = F.size(f"{t}w")
    whole = F.when(n_words > 0, F.array(F.xxhash64(F.col(f"{t}w")))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn(f"{t}g", F.when(n_words >= k, grams).otherwise(whole))
    grams = least = F.col(f"{t}g")
    covered = 1
    while covered < window:
        step = min(covered, window - covered)
        df = df.withColumn(f"{t}m{covered}", _join(least, least, step, lambda a, b: F.least(a, b)))
        least = F.col(f"{t}m{covered}")
        covered += step

    def rightmost(m: Column, i: Column) -> Column:
        found = i
        for j in range(1, window):
            found = F.when(F.get(grams, i + j) == m, i + j).otherwise(found)
        return found

    n = F.size(grams)
    one = F.when(n > 0, F.array((n - F.array_position(F.reverse(grams), F.array_min(grams))).cast("int"))).otherwise(F.array().cast("array<int>"))
    df = df.withColumn(f"{t}p", F.when(n >= window, F.array_distinct(F.transform(least, rightmost))).otherwise(one))
    df = df.withColumn(name, F.transform(f"{t}p", lambda p: F.struct(F.get(grams, p).alias("hash"), p.alias("position"))))
    return df.drop(*[c for c in df.columns if c.startswith(t)])


def fingerprint_hashes(entries: Column) -> Column:
    return F.array_distinct(entries["hash"])


def fingerprint_digest(entries: Column) -> Column:
    return F.concat(F.lower(F.lpad(F.hex(F.xxhash64(entries)), 16, "0")), F.lit("-"), F.size(entries).cast("string"))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct hashes; two empty ones are alike."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def fingerprints(docs: DataFrame, *, text_col: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """``docs`` with ``fingerprint``: its selected (hash, position) entries; see :func:`winnow_columns`."""
    return winnow_columns(docs.drop("fingerprint"), F.col(text_col), "fingerprint", k=k, window=window)


def with_next(docs: DataFrame, *, id_col: str = "doc_id", range_rows: int = RANGE_ROWS) -> DataFrame:
    """``docs`` dealt into ranges of ids, a task each (``_deal``), every range holding a copy
    (``_copy`` 1) of the first row of the range that follows it.

    One shuffle moves each row once; the ids alone are read before it, for range
    bounds and for the largest id of each range (at most MAX_RANGES rows)."""
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    n = docs.select(F.count("*")).first()[0]
    ranges = min(MAX_RANGES, -(-n // range_rows))
    bounds = quantile_bounds(docs, key, ranges)
    keyed = docs.withColumn("_key", key).withColumn("_range", range_number(bounds, F.col("_key")))
    heads = {r[0]: r[1] for r in keyed.select("_range", "_key").groupBy("_range").agg(F.max("_key")).collect()}
    order = sorted(heads)
    head_of = F.array(*[F.lit(heads.get(i)).cast("long") for i in range(len(bounds) + 1)])
    follows = dict(zip(order, order[1:] + order[:1], strict=True))  # the rows before a head lie in the next higher range
    goes_to = F.array(*[F.lit(follows.get(i)).cast("int") for i in range(len(bounds) + 1)])
    is_head = F.col("_key") == F.get(head_of, F.col("_range"))
    own = F.struct(F.col("_range").alias("range"), F.lit(0).alias("copy"))
    copy = F.struct(F.get(goes_to, F.col("_range")).alias("range"), F.lit(1).alias("copy"))
    dealt = keyed.withColumn("_to", F.explode(F.when(is_head, F.array(own, copy)).otherwise(F.array(own))))
    dealt = dealt.withColumn("_range", F.col("_to.range")).withColumn("_copy", F.col("_to.copy")).drop("_to")
    keys = _spread_keys(docs.sparkSession, len(bounds) + 1)
    dealt = dealt.withColumn("_deal", F.get(F.array(*[F.lit(k).cast("long") for k in keys]), F.col("_range"))).drop("_range")
    return dealt.repartition(len(keys), "_deal")


def _spread_keys(spark, n: int) -> list[int]:
    """n numbers that hash partitioning sends to n different partitions, so that no task gets two ranges."""
    end = int(n * (math.log(n + 1) + 8))
    found = spark.range(end).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("p")).agg(F.min("id").alias("id")).collect()
    keys = [r["id"] for r in found]
    return [*keys, *range(end, end + n - len(keys))]  # all different, whatever the partitions


def edited_and_next(docs: DataFrame) -> DataFrame:
    """For every document its fingerprint, that of its edited text and that of the next document.

    ``docs`` needs ``doc_id`` and ``text``; null text counts as empty, a null id as
    the smallest.  The next document is the one with the next smaller id (ties: by
    text), after the smallest the largest; a lone document is its own next.  The
    edited text has its last floor(n/3) code points replaced by the first as many
    of the next document.  Returns ``doc_id, n_chars, edited, fp, edited_fp,
    fp_hashes, edited_hashes, next_hashes`` (fingerprints, distinct hashes)."""
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    dealt = with_next(base)
    dealt = winnow_columns(dealt, F.col("text"), "fp")
    dealt = dealt.withColumn("fp_hashes", fingerprint_hashes(F.col("fp")))
    order = Window.partitionBy("_deal").orderBy("_copy", F.desc("_key"), "text")
    dealt = dealt.withColumn("_next", F.lead(F.struct("text", "fp_hashes")).over(order)).filter("_copy = 0")
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    out = dealt.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring("text", F.lit(1), n - cut), F.substring(F.col("_next.text"), F.lit(1), cut)))
    out = out.select("doc_id", "n_chars", "edited", "fp", "fp_hashes", F.col("_next.fp_hashes").alias("next_hashes"))
    out = winnow_columns(out, F.col("edited"), "edited_fp")
    return out.withColumn("edited_hashes", fingerprint_hashes(F.col("edited_fp")))


def op10_winnowing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = edited_and_next(docs)
    return out.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint_digest(F.col("fp")).alias("fingerprint"),
        fingerprint_digest(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp_hashes"), F.col("edited_hashes")).alias("near_edited"),
        likeness(F.col("fp_hashes"), F.col("next_hashes")).alias("near_next"),
    )
