"""Names of rows that need no id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_key(df: DataFrame) -> Column:
    """128 bits over all columns of a row: rows that agree in every column share it, others do not.

    Columns that Spark cannot hash (maps, variants) are left out."""
    plain = [F.col(f"`{f.name}`") for f in df.schema.fields if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    return F.struct(F.xxhash64(*plain).alias("a"), F.xxhash64(F.lit(1), *plain).alias("b"))
