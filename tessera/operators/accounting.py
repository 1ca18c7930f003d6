"""Counts that say where reads, wells and differences went."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.draws import uniform

from .windows import left_closed_bin, right_closed_bin


def demux_accounting(wells: DataFrame, *, raw: int, filtered: int, sequenced: Column) -> DataFrame:
    """One row: assigned reads, and those that wells without a library suggest to be false.

    A false assignment lands on any well alike, so the rate of unsequenced wells,
    scaled to the sequenced ones, estimates theirs.  ``wells``: n_reads."""
    n = F.col("n_reads")
    on, off = F.coalesce(sequenced, F.lit(False)), ~F.coalesce(sequenced, F.lit(False))
    s = wells.agg(
        F.sum(n).alias("assigned_reads"),
        F.coalesce(F.sum(F.when(on, n)), F.lit(0)).alias("reads_on_sequenced"),
        F.coalesce(F.sum(F.when(off, n)), F.lit(0)).alias("reads_on_unsequenced"),
        F.count_if(on).alias("_w"),
        F.count_if(off).alias("_u"),
        F.median(F.when(on, n)).alias("median_reads_per_sequenced_well"),
        F.max(F.when(off, n)).alias("max_reads_unsequenced_well"),
    )
    false = F.try_divide("reads_on_unsequenced", "_u") * F.col("_w")
    return s.withColumns({"pct_of_filtered": 100 * F.col("assigned_reads") / filtered, "pct_of_raw": 100 * F.col("assigned_reads") / raw, "est_false_reads": false, "est_false_rate_pct": 100 * F.try_divide(false, F.col("reads_on_sequenced"))}).drop("_w", "_u")


def share_change(counts: DataFrame, first: str, second: str) -> Column:
    """log2 of a well's share of one run over its share of another; null where it has no reads in either."""
    share = lambda c: F.try_divide(F.col(c), F.sum(c).over(Window.partitionBy(F.lit(1))))
    ratio = F.try_divide(share(second), F.nullif(share(first), F.lit(0.0)))
    return F.when(ratio > 0, F.log2(ratio))


def flips_by_separation(reads: DataFrame) -> DataFrame:
    """(bin, n_reads, n_flipped, pct_flipped): reads whose call differs between normalised and raw distances.

    ``reads``: read_len, len1, len2 of the references, dist1 and dist2 normalised; raw
    distances are recovered as round(dist * longer length)."""
    ed = lambda k: F.bround(F.col(f"dist{k}") * F.greatest("read_len", f"len{k}"))
    x = reads.withColumns({"_1": ed(1), "_2": ed(2)}).filter("_1 IS NOT NULL AND _2 IS NOT NULL")
    flip = (F.col("_1") != F.col("_2")) & ((F.col("dist1") < F.col("dist2")) != (F.col("_1") < F.col("_2")))
    k = right_closed_bin(F.abs(F.col("_1") - F.col("_2")), [-0.1, 0, 1, 2, 5, 10, 20, 50, 1e9])
    out = x.groupBy(k.alias("bin")).agg(F.count("*").alias("n_reads"), F.count_if(flip).alias("n_flipped"))
    return out.withColumn("pct_flipped", 100 * F.col("n_flipped") / F.col("n_reads"))


def resolution_by_bin(races: DataFrame, edges: list[float]) -> DataFrame:
    """Per bin of separation: couples, median, 90th and 95th percentile of the error, pooled rates of correct and tied reads."""
    error = F.try_divide(F.col("wrong"), F.col("n"))
    binned = races.withColumn("bin", right_closed_bin(F.col("bp"), edges)).filter("bin IS NOT NULL").withColumn("_e", error)
    q = lambda p: F.percentile("_e", F.lit(p))
    return binned.groupBy("bin").agg(
        F.count("*").alias("n_couples"), q(0.5).alias("median_error"), q(0.9).alias("p90_error"), q(0.95).alias("p95_error"), F.try_divide(F.sum("correct"), F.sum("n")).alias("correct"), F.try_divide(F.sum("tied"), F.sum("n")).alias("tied")
    )


def resolution_report(best: DataFrame, by: str) -> DataFrame:
    """Per source: queries, distinct targets, queries whose target another claims too, most claims on one target."""
    claims = best.groupBy(by, "best").agg(F.count("*").alias("k"))
    return claims.groupBy(by).agg(F.sum("k").alias("n"), F.count("*").alias("distinct_targets"), F.coalesce(F.sum(F.when(F.col("k") > 1, F.col("k"))), F.lit(0)).alias("collisions"), F.max("k").alias("max_claims"))


def growth_against_dropout(wells: DataFrame, blanks: DataFrame, *, dropout: Column, quantile: float = 0.99) -> DataFrame:
    """(dropout, grew, n): wells above a quantile of the blank wells' density, against those without usable reads.

    ``wells`` and ``blanks``: od."""
    cut = blanks.agg(F.percentile("od", F.lit(quantile)).alias("_cut"))
    return wells.join(F.broadcast(cut), F.lit(True)).groupBy(dropout.alias("dropout"), (F.col("od") > F.col("_cut")).alias("grew")).agg(F.count("*").alias("n"))


def failures_in_both(monos: DataFrame) -> DataFrame:
    """One row: strains with two monocultures of which both, one or none grew, and the enrichment of both failing over independence.

    ``monos``: strain, grew."""
    per = monos.groupBy("strain").agg(F.count("*").alias("n"), F.count_if("grew").alias("k")).filter("n = 2")
    rate = monos.agg(F.avg((~F.col("grew")).cast("double")).alias("_p"))
    s = per.agg(F.count("*").alias("n_strains"), F.count_if(F.col("k") == 0).alias("both_failed"), F.count_if(F.col("k") == 1).alias("one_failed"), F.count_if(F.col("k") == 2).alias("none_failed"))
    out = s.join(F.broadcast(rate), F.lit(True))  # two tables of one row
    expected = F.col("n_strains") * F.col("_p") * F.col("_p")
    return out.withColumns({"expected_both": expected, "enrichment": F.try_divide(F.col("both_failed"), F.nullif(expected, F.lit(0.0)))}).drop("_p")


def dose_response(wells: DataFrame, *, unit: str, dose: str, value: str) -> DataFrame:
    """(unit, n_doses, low, high, log2_span): medians at the lowest and highest dose of units with two doses or more."""
    per = wells.groupBy(unit, dose).agg(F.median(value).alias("m"))
    out = per.groupBy(unit).agg(F.count("*").alias("n_doses"), F.min_by("m", dose).alias("low"), F.max_by("m", dose).alias("high")).filter("n_doses > 1")
    return out.withColumn("log2_span", F.when((F.col("low") > 0) & (F.col("high") > 0), F.log2(F.col("high") / F.col("low"))))


def length_classes(reads: DataFrame, *, run: str, length: str, reason: str, edges: list[float]) -> DataFrame:
    """(run, length class, reason, n, pct within the class); classes closed on the left."""
    c = reads.groupBy(run, left_closed_bin(F.col(length), edges).alias("length_class"), reason).agg(F.count("*").alias("n"))
    return c.withColumn("pct", 100 * F.col("n") / F.sum("n").over(Window.partitionBy(run, "length_class")))


def standard_wells(wells: DataFrame, *, min_reads: int, min_bp: float, types: tuple[str, ...] = ("pair", "techrep")) -> DataFrame:
    """Wells under the standard condition: of these types, equal volumes, both references, far enough apart, enough reads."""
    return wells.filter(F.col("well_type").isin(*types) & (F.col("vol1_nL") == F.col("vol2_nL")) & ~F.col("missing_reference") & (F.col("ref_pair_bp_dist") >= min_bp) & (F.col("n_reads") >= min_reads))


def organism_label(nearest: Column, ties: Column, bp: Column, group: Column, *, limit_bp: float = 10) -> Column:
    """``unk`` beyond the limit, the group of references that cannot be told apart, else the nearest strain."""
    return F.when(nearest.isNull() | (bp > limit_bp), "unk").when(F.size(ties) > 1, F.coalesce(group, nearest)).otherwise(nearest)


def mono_strain(strain1: Column, strain2: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(strain1), F.lit("")), F.nullif(F.trim(strain2), F.lit("")))


def nested_sets(scored: DataFrame, score: str, limits: list[float]) -> DataFrame:
    """Strains by the highest of ascending limits that their score reaches: ``tier`` counts the limits met."""
    tier = F.lit(0)
    for t in limits:
        tier = tier + F.when(F.col(score) >= t, 1).otherwise(0)
    return scored.withColumn("tier", tier)


def downsampled(reads: DataFrame, fraction: float, *, key: str = "read_id", seed: int = 0) -> DataFrame:
    """Reads whose seeded hash falls below the fraction: the same ones on any partitioning, larger samples holding smaller ones."""
    u = uniform(seed, key)
    return reads.filter(u < fraction)


def stratified_sample(df: DataFrame, stratum: str, per: int, *, key: str, seed: int = 0) -> DataFrame:
    """``per`` rows of each stratum by seeded hash order."""
    w = Window.partitionBy(stratum).orderBy(uniform(seed, key), key)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= per).drop("_n")
