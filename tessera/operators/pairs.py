"""Unordered strain pairs: keys, orientation, symmetric views, replicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.draws import uniform


def pair_key(a: Column, b: Column) -> Column:
    """The unordered key of a pair: a struct of its smaller and larger member."""
    return F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))


def canonical(df: DataFrame, first: str = "strain1", second: str = "strain2", *, share: str = "relative_abundance_strain1", ratio: str = "log2_ratio_strain1_over_strain2") -> DataFrame:
    """Adds ``strain_a < strain_b`` and the outcome seen from ``strain_a``: a swap turns a share s into 1 - s and a log ratio r into -r."""
    flip = F.col(first) > F.col(second)
    return df.withColumns(
        {
            "strain_a": F.least(first, second),
            "strain_b": F.greatest(first, second),
            "relative_abundance_a": F.when(flip, 1 - F.col(share)).otherwise(F.col(share)),
            "log2_ratio_a_over_b": F.when(flip, -F.col(ratio)).otherwise(F.col(ratio)),
        }
    )


def both_orientations(pairs: DataFrame, *, share: str = "mean_relative_abundance_a", ratio: str = "mean_log2_ratio_a_over_b", keep: tuple[str, ...] = ()) -> DataFrame:
    """Every pair as seen by each of its members: ``strain, opponent, share_self, ratio_self``.

    One pass over the pairs; a filter on ``strain`` gives the view of one member."""
    a = F.struct(F.col("strain_a").alias("strain"), F.col("strain_b").alias("opponent"), F.col(share).alias("share_self"), F.col(ratio).alias("ratio_self"))
    b = F.struct(F.col("strain_b").alias("strain"), F.col("strain_a").alias("opponent"), (1 - F.col(share)).alias("share_self"), (-F.col(ratio)).alias("ratio_self"))
    return pairs.select(F.explode(F.array(a, b)).alias("v"), *keep).select("v.*", *keep)


def orient_to_strain(pairs: DataFrame, strain: str, **columns) -> DataFrame:
    return both_orientations(pairs, **columns).filter(F.col("strain") == strain)


def within_pair_replicates(wells: DataFrame, *, id_col: str = "sample_id", value: str = "log2_ratio_a_over_b", seed: int = 0) -> DataFrame:
    """Every unordered couple of wells of the same pair: ``strain_a, strain_b, x, y``.

    Which of the two is x is decided by a hash of both ids and the seed, so the
    regression of y on x has no preferred direction and reruns agree."""
    left = wells.select("strain_a", "strain_b", F.col(id_col).alias("_i"), F.col(value).alias("_x"))
    right = wells.select("strain_a", "strain_b", F.col(id_col).alias("_j"), F.col(value).alias("_y"))
    flip = uniform(seed, "_i", "_j") < 0.5
    both = left.join(right, ["strain_a", "strain_b"]).filter(F.col("_i") < F.col("_j"))
    return both.select("strain_a", "strain_b", F.when(flip, F.col("_y")).otherwise(F.col("_x")).alias("x"), F.when(flip, F.col("_x")).otherwise(F.col("_y")).alias("y"))


def across_pair_replicates(first: DataFrame, second: DataFrame, *, value: str = "log2_ratio_a_over_b") -> DataFrame:
    """Every well of one experiment with every well of the same pair in another."""
    left = first.select("strain_a", "strain_b", F.col(value).alias("x"))
    return left.join(second.select("strain_a", "strain_b", F.col(value).alias("y")), ["strain_a", "strain_b"])


def ordinal_swap(df: DataFrame, *, group: str, order: list[str], groups: tuple, columns: list[str]) -> DataFrame:
    """Exchanges ``columns`` between the rows of two groups, row by row in ``order``; raises if the groups differ in size."""
    from pyspark.sql import Window

    first, second = groups
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    other = F.when(F.col(group) == first, F.lit(second)).when(F.col(group) == second, F.lit(first))
    source = ranked.filter(F.col(group).isin(first, second)).select(F.col(group).alias("_g"), F.col("_n").alias("_m"), *[F.col(c).alias(f"_{c}") for c in columns])
    joined = ranked.withColumn("_o", other).join(source, (F.col("_o") == F.col("_g")) & (F.col("_n") == F.col("_m")), "left")
    guard = F.when(F.col("_o").isNotNull() & F.col("_g").isNull(), F.raise_error(F.lit("the groups differ in size")).cast("int"))
    return joined.withColumns({c: F.when(F.col("_g").isNotNull(), F.col(f"_{c}")).otherwise(F.when(guard.isNull(), F.col(c))) for c in columns}).select(df.columns)
