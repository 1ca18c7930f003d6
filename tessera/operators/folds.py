"""Cross-validation folds that keep organisms apart, and leakage controls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.draws import uniform
from tessera.storage import materialize, sent

#: A fold of pairs needs so many test pairs to be evaluated (fixed value).
MIN_TEST_PAIRS = 5


def unit_folds(units: DataFrame, unit: str, n_splits: int, *, seed: int = 0, repeats: int = 1) -> DataFrame:
    """(rep, unit, fold): units dealt evenly to folds in the order of a seeded hash, anew for each repeat."""
    draw = uniform(seed, "rep", unit)
    every = units.select(unit).distinct().withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    place = F.row_number().over(Window.partitionBy("rep").orderBy(draw, unit))
    return every.select("rep", unit, ((place - 1) % n_splits).alias("fold"))


def strain_folds(pairs: DataFrame, folds: DataFrame, *, unit: str = "strain", a: str = "strain_a", b: str = "strain_b", least: int = MIN_TEST_PAIRS) -> DataFrame:
    """(rep, fold, strain_a, strain_b, role): both members in the fold: test; neither: train; straddling pairs vanish.

    Folds with fewer than ``least`` test pairs are left out."""
    folds = sent(materialize(folds.select("rep", unit, "fold"), "folds"))
    left = folds.select("rep", F.col(unit).alias(a), F.col("fold").alias("_fa"))
    right = folds.select(F.col("rep").alias("_rep"), F.col(unit).alias(b), F.col("fold").alias("_fb"))
    placed = pairs.select(a, b).join(left, a).join(right, b).filter("rep = _rep")
    every = folds.select("rep", "fold").distinct()
    rows = placed.join(F.broadcast(every), "rep").withColumn(
        "role", F.when((F.col("_fa") == F.col("fold")) & (F.col("_fb") == F.col("fold")), "test").when((F.col("_fa") != F.col("fold")) & (F.col("_fb") != F.col("fold")), "train")
    ).filter("role IS NOT NULL")
    enough = rows.groupBy("rep", "fold").agg(F.count_if(F.col("role") == "test").alias("_n")).filter(F.col("_n") >= least)
    return rows.join(F.broadcast(materialize(enough, "enough")), ["rep", "fold"]).select("rep", "fold", a, b, "role")


def pair_folds(pairs: DataFrame, n_splits: int, *, seed: int = 0, a: str = "strain_a", b: str = "strain_b") -> DataFrame:
    """(strain_a, strain_b, fold): unordered pairs dealt to folds, so both orientations share one."""
    draw = uniform(seed, F.least(a, b), F.greatest(a, b))
    return pairs.select(a, b).withColumn("fold", F.floor(draw * n_splits).cast("int"))


def purge(roles: DataFrame, organism: DataFrame, *, a: str = "strain_a", b: str = "strain_b") -> DataFrame:
    """``roles`` without the training pairs of a fold that hold an organism of its test pairs.

    ``organism``: (strain, organism).  Folds are barred strain by strain, so pairs are only filtered; they are not dealt anew."""
    of = organism.select("strain", "organism")
    key = F.shiftleft(F.col("rep").cast("long"), 32) + F.col("fold")
    tested = roles.filter("role = 'test'").select(key.alias("_key"), F.explode(F.array(a, b)).alias("strain")).distinct()
    seen = tested.join(of, "strain").select("_key", "organism").distinct()
    barred = sent(materialize(of.join(seen, "organism").groupBy("strain").agg(F.collect_set("_key").alias("_barred")), "barred"))
    train = roles.filter("role = 'train'")
    for side in (a, b):
        train = train.join(barred.select(F.col("strain").alias(side), F.col("_barred").alias(f"_{side}")), side, "left")
    free = [F.coalesce(~F.array_contains(f"_{side}", key), F.lit(True)) for side in (a, b)]
    return train.filter(free[0] & free[1]).select(roles.columns).unionByName(roles.filter("role = 'test'"))


def exposure(roles: DataFrame, organism: DataFrame, *, a: str = "strain_a", b: str = "strain_b") -> DataFrame:
    """Test pairs with ``exposed``: how many of their two members have their organism in the fold's training pairs."""
    of = organism.select("strain", "organism")
    members = roles.select("rep", "fold", "role", a, b, F.posexplode(F.array(a, b)).alias("side", "strain")).join(of, "strain", "left")
    seen = members.filter("role = 'train'").select("rep", "fold", "organism").distinct().withColumn("_hit", F.lit(1))
    test = members.filter("role = 'test'").join(seen, ["rep", "fold", "organism"], "left")
    return test.groupBy("rep", "fold", a, b).agg(F.coalesce(F.sum("_hit"), F.lit(0)).alias("exposed"))


def summarise_folds(folds: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Folds, and mean and standard deviation of each metric."""
    return folds.groupBy(*by).agg(F.count_distinct("fold").alias("n_folds"), *[f(m).alias(f"{n}_{m}") for m in metrics for n, f in (("mean", F.avg), ("sd", F.stddev_samp))])


def repeat_summary(folds: DataFrame, by: list[str], metric: str) -> DataFrame:
    """Mean over folds of each repeat, then mean and spread of these; and the median over all folds."""
    per = folds.groupBy(*by, "rep").agg(F.avg(metric).alias("_m")).groupBy(*by).agg(F.avg("_m").alias(f"mean_{metric}"), F.stddev_samp("_m").alias(f"sd_{metric}"))
    return per.join(folds.groupBy(*by).agg(F.median(metric).alias(f"median_{metric}")), by)


def paired_deltas(folds: DataFrame, *, arm: str, baseline: str, keys: list[str], metric: str) -> DataFrame:
    """Per arm the mean difference to the baseline over common folds, its standard error, and the share of folds that gain."""
    base = folds.filter(F.col(arm) == baseline).select(*keys, F.col(metric).alias("_base"))
    d = folds.filter(F.col(arm) != baseline).join(base, keys).withColumn("_d", F.col(metric) - F.col("_base"))
    return d.groupBy(arm).agg(F.count("*").alias("n"), F.avg("_d").alias("mean_delta"), (F.stddev_samp("_d") / F.sqrt(F.count("*"))).alias("se_delta"), F.avg((F.col("_d") > 0).cast("double")).alias("share_better"))


def label_subsets(predictions: DataFrame, wrong: DataFrame, *, a: str = "strain_a", b: str = "strain_b") -> DataFrame:
    """``any_wrong`` and ``both_ok`` of each pair, from the strains whose label is known to be wrong."""
    w = wrong.select("strain").distinct()
    out = predictions
    for side, c in (("_wa", a), ("_wb", b)):
        out = out.join(w.select(F.col("strain").alias(c), F.lit(True).alias(side)), c, "left")
    any_wrong: Column = F.coalesce("_wa", F.lit(False)) | F.coalesce("_wb", F.lit(False))
    return out.withColumns({"any_wrong": any_wrong, "both_ok": ~any_wrong}).drop("_wa", "_wb")
