"""Sparse feature tables (strain, feature, cnt) and features of pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.storage import materialize, sent


def presence(cnt: Column) -> Column:
    return (cnt > 0).cast("int")


def present(features: DataFrame, *, strain: str = "strain", feature: str = "feature", cnt: str | None = None) -> DataFrame:
    rows = features.filter(F.col(cnt) > 0) if cnt else features
    return rows.select(strain, feature).distinct()


def empty_strains(features: DataFrame, cnt: str = "cnt") -> DataFrame:
    """Strains without a single feature."""
    return features.groupBy("strain").agg(F.sum(F.coalesce(cnt, F.lit(0))).alias("t")).filter("t = 0").select("strain")


def prevalent(features: DataFrame, least: int, *, cnt: str = "cnt") -> DataFrame:
    """Rows of features present in at least ``least`` strains and absent from at least as many."""
    has = features.filter(F.col(cnt) > 0)
    n = features.select("strain").distinct().count()
    keep = has.groupBy("feature").agg(F.count_distinct("strain").alias("n")).filter(F.col("n").between(least, n - least)).select("feature")
    return has.join(keep, "feature", "left_semi")


#: Couples that a task of :func:`shared_features` counts, some 40 bytes each before they are summed.
TASK_COUPLES = 4_000_000


def shared_features(features: DataFrame) -> DataFrame:
    """For pairs a < b that share a feature: shared, only_a, only_b and the Jaccard similarity.

    Meets pairs only at common features; pairs without any have 0 shared by absence.  What is shuffled is not a row for
    each couple but, for each strain and feature, the list of the later strains; all couples of a strain are counted in one task."""
    kind = dict(features.dtypes)["strain"]
    lists = features.filter("strain IS NOT NULL").select("strain", "feature").repartition("feature").groupBy("feature").agg(F.collect_set("strain").alias("l"))
    lists = materialize(lists, "lists")
    sizes = materialize(lists.select(F.explode("l").alias("strain")).groupBy("strain").agg(F.count("*").alias("n")), "sizes")
    small = kind == "bigint" and sizes.agg(F.coalesce(F.min("strain") >= -(1 << 31), F.lit(True)) & F.coalesce(F.max("strain") < 1 << 31, F.lit(True))).first()[0]
    k = F.size("l").cast("long")
    couples = lists.filter("feature IS NOT NULL").agg(F.coalesce(F.sum(k * (k - 1) / 2), F.lit(0.0))).first()[0]
    tasks = max(int(features.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(couples // TASK_COUPLES))
    sorted_ = lists.filter("feature IS NOT NULL").select(F.sort_array(F.col("l").cast("array<int>") if small else "l").alias("l"))
    later = sorted_.select(F.posexplode("l").alias("_k", "a"), "l").filter(F.col("_k") + 1 < F.size("l")).select("a", F.slice("l", F.col("_k") + 2, F.size("l")).alias("l"))
    shared = later.repartition(tasks, "a").select("a", F.explode("l").alias("b")).groupBy("a", "b").agg(F.count("*").alias("shared"))
    shared, sizes = shared.select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b"), "shared"), sent(sizes)
    out = shared.join(sizes.select(F.col("strain").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("strain").alias("b"), F.col("n").alias("nb")), "b")
    both = F.col("shared")
    return out.select("a", "b", "shared", (F.col("na") - both).alias("only_a"), (F.col("nb") - both).alias("only_b"), (both / (F.col("na") + F.col("nb") - both)).alias("jaccard"))


def pair_metabolism(pairs: DataFrame, features: DataFrame, *, a: str = "strain_a", b: str = "strain_b") -> DataFrame:
    """Per tested pair: shared, complementary (either alone), advantage (only a - only b), Jaccard, from feature sets as arrays."""
    sets = present(features).groupBy("strain").agg(F.collect_set("feature").alias("f"))
    out = pairs.join(sets.select(F.col("strain").alias(a), F.col("f").alias("fa")), a, "left").join(sets.select(F.col("strain").alias(b), F.col("f").alias("fb")), b, "left")
    fa, fb = F.col("fa"), F.col("fb")
    shared, only_a, only_b = F.size(F.array_intersect(fa, fb)), F.size(F.array_except(fa, fb)), F.size(F.array_except(fb, fa))
    return out.withColumns({"shared": shared, "complementary": only_a + only_b, "advantage": only_a - only_b, "jaccard": F.try_divide(shared, shared + only_a + only_b)}).drop("fa", "fb")


def pair_design(za: Column, zb: Column, *, symmetric: bool) -> Column:
    """Array features of a pair: differences then sums (their sign turns with the pair), or sums then absolute differences."""
    diff = F.zip_with(za, zb, lambda x, y: x - y)
    total = F.zip_with(za, zb, lambda x, y: x + y)
    if symmetric:
        return F.concat(total, F.zip_with(za, zb, lambda x, y: F.abs(x - y)))
    return F.concat(diff, total)
