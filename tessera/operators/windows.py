"""Window transforms within plates, wells and ordered series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def zscore(value: str, by: list[str]) -> Column:
    """(x - mean) / population standard deviation within the group; null where that is 0."""
    w = Window.partitionBy(*by)
    return F.try_divide(F.col(value) - F.avg(value).over(w), F.nullif(F.stddev_pop(value).over(w), F.lit(0.0)))


def detrend(value: str, plate: list[str], row: str, col: str) -> Column:
    """x - row mean + grand mean - column mean, within a plate."""
    x = F.col(value)
    grand = F.avg(value).over(Window.partitionBy(*plate))
    return x - F.avg(value).over(Window.partitionBy(*plate, row)) - F.avg(value).over(Window.partitionBy(*plate, col)) + grand


def sum_before(value: str, by: list[str], order: list) -> Column:
    """Sum over the rows before this one; 0 for the first."""
    return F.coalesce(F.sum(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def rolling_mean(value: str, by: list[str], order: list, rows: int = 15) -> Column:
    """Mean over the last ``rows`` rows, fewer at the start."""
    return F.avg(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(1 - rows, 0))


def growth_parameters(cycles: DataFrame, *, by: list[str], order: str, od: str, lag: int = 4, floor: float = 1e-3) -> DataFrame:
    """Maximum, total increase and steepest log slope over ``lag`` cycles of each growth curve."""
    w = Window.partitionBy(*by).orderBy(order)
    log = F.log(F.greatest(F.col(od), F.lit(floor)))
    slope = cycles.withColumn("_slope", (log - F.lag(log, lag).over(w)) / lag)
    return slope.groupBy(*by).agg(F.max(od).alias("max_od"), (F.max_by(od, order) - F.min_by(od, order)).alias("delta_od"), F.max("_slope").alias("max_log_slope"))


def best(df: DataFrame, by: list[str], order: list, n: int = 1) -> DataFrame:
    """The first ``n`` rows of each group in ``order``, which has to be total for a reproducible pick."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


def average_rank(value: str, by: list[str]) -> Column:
    """Ranks from 1 within the group, equal values sharing the mean of theirs."""
    w = Window.partitionBy(*by)
    return F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2


def with_q_values(df: DataFrame, p: str, by: list[str], *, step_up: bool = True, name: str = "q") -> DataFrame:
    """Benjamini-Hochberg q-values: p * n / rank, with the running minimum from the largest p
    down unless ``step_up`` is off (the form without it is kept for comparison)."""
    w = Window.partitionBy(*by)
    ranked = df.withColumn("_rank", F.rank().over(w.orderBy(p)) + F.count("*").over(Window.partitionBy(*by, p)) - 1)
    raw = ranked.withColumn("_raw", F.col(p) * F.count(p).over(w) / F.col("_rank"))
    if step_up:
        down = w.orderBy(F.desc(p)).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        raw = raw.withColumn("_raw", F.min("_raw").over(down))
    return raw.withColumn(name, F.least(F.lit(1.0), F.col("_raw"))).drop("_rank", "_raw")


def weighted_median(df: DataFrame, *, by: list[str], value: str, weight: str) -> DataFrame:
    """The first value, in ascending order, at which the running share of the weight reaches one half."""
    w = Window.partitionBy(*by)
    share = df.withColumn("_share", F.sum(weight).over(w.orderBy(value)) / F.sum(weight).over(w))
    return share.filter("_share >= 0.5").groupBy(*by).agg(F.min(value).alias("weighted_median"))


def quantile_bins(value: str, by: list[str], bins: int, tie: list) -> Column:
    """Equal-frequency bins from 1 after ordering by value and ``tie``."""
    w = Window.partitionBy(*by) if by else Window
    return F.ntile(bins).over(w.orderBy(value, *tie))


def right_closed_bin(value: Column, edges: list[float]) -> Column:
    """Index from 0 of the bin (edge, next edge] that holds the value; null outside."""
    out = F.lit(None).cast("int")
    for k in reversed(range(len(edges) - 1)):
        out = F.when((value > edges[k]) & (value <= edges[k + 1]), k).otherwise(out)
    return out


def left_closed_bin(value: Column, edges: list[float]) -> Column:
    """Index from 0 of the bin [edge, next edge) that holds the value; null outside."""
    out = F.lit(None).cast("int")
    for k in reversed(range(len(edges) - 1)):
        out = F.when((value >= edges[k]) & (value < edges[k + 1]), k).otherwise(out)
    return out


def inclusive_bin(value: Column, bins: list[tuple[float, float]]) -> Column:
    """First bin [lo, hi] with both ends closed that holds the value, as ``lo-hi``."""
    out = F.lit(None).cast("string")
    for lo, hi in reversed(bins):
        out = F.when((value >= lo) & (value <= hi), f"{lo}-{hi}").otherwise(out)
    return out
