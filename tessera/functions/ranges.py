"""Equal-frequency ranges of a key, as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quantile_bounds(df: DataFrame, key: Column, ranges: int) -> list:
    """Sorted distinct bounds between at most ``ranges`` ranges of about equally many rows."""
    if ranges <= 1:
        return []
    parts = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    found = df.select(F.percentile_approx(key, parts, F.lit(max(10_000, 20 * ranges)))).first()[0]
    return sorted(set(found or []))


def range_number(bounds: list, value: Column) -> Column:
    """How many of the sorted ``bounds`` are at most ``value``: a binary search in a literal array."""
    if not bounds:
        return F.lit(0)
    steps = len(bounds).bit_length()
    table = F.array(*[F.lit(b).cast("long") for b in bounds])
    return F.aggregate(
        F.array(*[F.lit(1 << s) for s in reversed(range(steps))]),
        F.lit(0),
        lambda low, step: F.when(F.coalesce(F.get(table, low + step - 1) <= value, F.lit(False)), low + step).otherwise(low),
    )
