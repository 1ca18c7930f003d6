"""Reshaping, counting and comparing whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def crosstab_shares(df: DataFrame, rows: str, columns: str, values: list) -> DataFrame:
    """Share of each of the known ``values`` within a row, and the row's size: one aggregation."""
    shares = [(F.count_if(F.col(columns) == v) / F.count("*")).alias(str(v)) for v in values]
    return df.groupBy(rows).agg(F.count("*").alias("n"), *shares)


def hourly_trend(df: DataFrame, *, time: str, value: str, unit: str, good: Column) -> DataFrame:
    """By hour since the epoch: rows, share of good ones, median of the value, distinct units."""
    hour = F.floor(F.unix_micros(F.col(time).cast("timestamp")) / 3_600_000_000).alias("hour")
    return df.groupBy(hour).agg(F.count("*").alias("n"), F.avg(good.cast("double")).alias("share_good"), F.median(value).alias("median_value"), F.count_distinct(unit).alias("n_units"))


def unpivot_cells(df: DataFrame, ids: list[str], columns: list[str], *, name: str = "feature", value: str = "value") -> DataFrame:
    """Wide to long; the columns need one type."""
    return df.unpivot(ids, columns, name, value)


def step_counts(df: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """Rows left after each of a chain of filters, counted in one pass: (step from 1, name, n)."""
    held, sums = F.lit(True), []
    for k, (_, condition) in enumerate(steps):
        held = held & F.coalesce(condition, F.lit(False))
        sums.append(F.count_if(held).alias(f"n{k}"))
    rows = F.array(*[F.struct(F.lit(k + 1).alias("step"), F.lit(name).alias("name"), F.col(f"n{k}").alias("n")) for k, (name, _) in enumerate(steps)])
    return df.agg(*sums).select(F.explode(rows).alias("s")).select("s.*")


def set_overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: distinct rows in both, only left, only right, from one aggregation over both."""
    keys = left.columns
    both = left.withColumn("_l", F.lit(True)).withColumn("_r", F.lit(False)).unionByName(right.withColumn("_l", F.lit(False)).withColumn("_r", F.lit(True)))
    seen = both.groupBy(*keys).agg(F.bool_or("_l").alias("l"), F.bool_or("_r").alias("r"))
    l, r = F.col("l"), F.col("r")
    return seen.agg(F.count_if(l & r).alias("n_both"), F.count_if(l & ~r).alias("n_left"), F.count_if(r & ~l).alias("n_right"))


def same_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one table holds more often than the other, with ``side``: empty for equal tables in any order."""
    columns = left.columns
    a = left.exceptAll(right.select(columns)).withColumn("side", F.lit("left"))
    return a.unionByName(right.select(columns).exceptAll(left).withColumn("side", F.lit("right")))


def merged_counts(first: DataFrame, second: DataFrame, *, key: str, counts: list[str]) -> DataFrame:
    """Counts of two runs summed by key; a key of either run is kept."""
    return first.select(key, *counts).unionByName(second.select(key, *counts)).groupBy(key).agg(*[F.sum(c).alias(c) for c in counts])


def share_dispersion(counts: DataFrame, *, unit: str, run: str, n: str) -> DataFrame:
    """One row: Pearson chi-squared of units by runs over its degrees of freedom."""
    units = counts.groupBy(unit).agg(F.sum(n).alias("_u"))
    runs = counts.groupBy(run).agg(F.sum(n).alias("_r"))
    total = counts.agg(F.sum(n).alias("t"), F.count_distinct(unit).alias("nu"), F.count_distinct(run).alias("nr"))
    cells = counts.join(units, unit).join(runs, run).agg(F.sum(F.col(n) * F.col(n) / (F.col("_u") * F.col("_r"))).alias("s"))
    out = cells.join(F.broadcast(total), F.lit(True))  # two tables of one row each
    df = (F.col("nu") - 1) * (F.col("nr") - 1)
    chi2 = F.col("t") * (F.col("s") - 1)
    return out.select(chi2.alias("chi2"), df.alias("df"), F.try_divide(chi2, df).alias("dispersion"))


def canonical_matrix(edges: DataFrame, a: str, b: str, carry: list[tuple[str, str]]) -> DataFrame:
    """Edges with a < b; each pair of columns in ``carry`` swaps along, repeated pairs count once."""
    flip = F.col(a) > F.col(b)
    swaps = {}
    for x, y in carry:
        swaps |= {x: F.when(flip, F.col(y)).otherwise(F.col(x)), y: F.when(flip, F.col(x)).otherwise(F.col(y))}
    return edges.withColumns(swaps | {a: F.least(a, b), b: F.greatest(a, b)}).dropDuplicates([a, b])
