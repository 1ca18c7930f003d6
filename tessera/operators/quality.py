"""Status ladders, confidence tiers and contamination summaries as ordered conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Thresholds of the quality ladders (fixed values).
MIN_STRAIN_READS, MIN_STRAIN_FRAC = 3, 0.10
CONTAM_MIN_FRAC, CONTAM_MIN_READS = 0.20, 3
GENOME_MATCH, GENOME_MISMATCH = 0.002, 0.01


def read_cutoff(n_reads: Column) -> Column:
    """Reads that a strain needs in a well to count as present."""
    return F.greatest(F.lit(MIN_STRAIN_READS).cast("long"), F.ceil(F.lit(MIN_STRAIN_FRAC) * n_reads).cast("long"))


def qc_status(well_type: Column, n_reads: Column, n1: Column, n2: Column) -> Column:
    """Status of a well from its confident reads; a null count (strain without a reference) is not present."""
    cutoff = read_cutoff(n_reads)
    one, two = F.coalesce(n1 >= cutoff, F.lit(False)), F.coalesce(n2 >= cutoff, F.lit(False))
    return (
        F.when(well_type == "mono", F.when(one, "mono_confirmed").otherwise("mono_low_confidence"))
        .when(one & two, "pair_both_confirmed")
        .when(one | two, "pair_single_dominant")
        .otherwise("pair_neither_confirmed")
    )


def contaminated(other_frac: Column, other_count: Column) -> Column:
    return F.coalesce((other_frac >= CONTAM_MIN_FRAC) & (other_count >= CONTAM_MIN_READS), F.lit(False))


def best_hit_summary(hits: DataFrame, *, by: str, hit: str, expected: Column) -> DataFrame:
    """By sample: share of expected and of unmapped reads, the most frequent unexpected hit with its count and share.

    Two levels of aggregation; ties go to the hit that sorts first."""
    counts = hits.groupBy(by, F.col(hit).alias("_hit"), expected.alias("_expected")).agg(F.count("*").alias("_n"))
    other = ~F.coalesce(F.col("_expected"), F.lit(False)) & F.col("_hit").isNotNull()
    per = counts.withColumn("_rank", F.when(other, F.row_number().over(Window.partitionBy(by, other).orderBy(F.desc("_n"), "_hit"))))
    out = per.groupBy(by).agg(
        F.sum("_n").alias("n_reads"),
        F.coalesce(F.sum(F.when(F.col("_expected"), F.col("_n"))), F.lit(0)).alias("_ne"),
        F.coalesce(F.sum(F.when(F.col("_hit").isNull(), F.col("_n"))), F.lit(0)).alias("_nu"),
        F.max(F.when(F.col("_rank") == 1, F.col("_hit"))).alias("top_other"),
        F.coalesce(F.max(F.when(F.col("_rank") == 1, F.col("_n"))), F.lit(0)).alias("top_other_count"),
    )
    n = F.col("n_reads")
    return out.select(by, "n_reads", (F.col("_ne") / n).alias("frac_expected"), (F.col("_nu") / n).alias("frac_unmapped"), "top_other", "top_other_count", (F.col("top_other_count") / n).alias("top_other_frac"))


def confident_summary(reads: DataFrame, *, by: str, threshold: float | Column) -> DataFrame:
    """By sample: confident reads and shares of either strain (null if it is no candidate), median best distance.

    ``reads``: by, best_match, best_dist, strain1, strain2, candidate1, candidate2."""
    sure = F.col("best_dist") < threshold

    def of(strain: str) -> tuple[Column, Column]:
        candidate = F.bool_or(F.coalesce(F.col("candidate1") == F.col(strain), F.lit(False)) | F.coalesce(F.col("candidate2") == F.col(strain), F.lit(False)))
        n = F.count_if(sure & (F.col("best_match") == F.col(strain)))
        return F.when(candidate, n), F.when(candidate, n / F.count("*"))

    (n1, f1), (n2, f2) = of("strain1"), of("strain2")
    return reads.groupBy(by).agg(n1.alias("n_conf_strain1"), n2.alias("n_conf_strain2"), f1.alias("frac_strain1"), f2.alias("frac_strain2"), F.median("best_dist").alias("median_best_dist"))


def distance_class(bp: Column, plain_bp: Column, limit_bp: float = 10, close_bp: float = 0) -> Column:
    """identical (0 plain differences), indistinguishable (0 after ambiguity codes), close (below the limit) or distinguishable."""
    return F.when(plain_bp == 0, "identical").when(bp <= close_bp, "indistinguishable").when(bp < limit_bp, "close").when(bp.isNotNull(), "distinguishable")


def genome_call(distance: Column) -> Column:
    """Call of a genome from its normalised distance to the measured sequence; no sequence: no_16S."""
    return F.when(distance.isNull(), "no_16S").when(distance <= GENOME_MATCH, "match").when(distance >= GENOME_MISMATCH, "mismatch").otherwise("ambiguous")


def first_reason(reasons: list[tuple[str, Column]]) -> Column:
    """Name of the first condition that holds; null if none does (a null condition does not hold)."""
    return F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in reasons])


def eligibility(reasons: list[tuple[str, Column]], high: Column) -> Column:
    """``exclude`` where a reason holds, else ``high`` or ``medium``."""
    return F.when(first_reason(reasons).isNotNull(), "exclude").when(F.coalesce(high, F.lit(False)), "high").otherwise("medium")


def confidence_tier(identity: Column, margin: Column, mono_agrees: Column, *, strict: float = 0.995, loose: float = 0.98, min_margin: float = 0.002) -> Column:
    sure = (identity >= strict) & (margin >= min_margin)
    return F.when(sure & mono_agrees, "A").when(sure, "B").when(identity >= loose, "C").otherwise("D")


def odd_one_out(ab: Column, ac: Column, bc: Column) -> Column:
    """Which of three sources disagrees with the two others, given their pairwise agreement."""
    return (
        F.when(ab & ac & bc, "none").when(ab & ~ac & ~bc, "c").when(ac & ~ab & ~bc, "b").when(bc & ~ab & ~ac, "a").when(~ab & ~ac & ~bc, "all").otherwise("inconsistent")
    )


def identity_verdict(best: Column, expected: Column, in_reference: Column, is_twin: Column) -> Column:
    """supported, ambiguous (a twin of the expected is nearest), contradicted, or absent."""
    return F.when(~in_reference | best.isNull(), "absent").when(best == expected, "supported").when(F.coalesce(is_twin, F.lit(False)), "ambiguous").otherwise("contradicted")


def support_summary(verdicts: DataFrame, by: list[str]) -> DataFrame:
    """supported / (supported + contradicted) by group; null where nothing is decidable."""
    n = {v: F.count_if(F.col("verdict") == v) for v in ("supported", "contradicted", "ambiguous", "absent")}
    out = verdicts.groupBy(*by).agg(*[c.alias(v) for v, c in n.items()])
    decidable = F.col("supported") + F.col("contradicted")
    return out.withColumn("n_decidable", decidable).withColumn("label_support", F.try_divide("supported", decidable))


def consensus_status(monos_agree: Column, monos_seen: Column, pair_wells: Column, wells: Column, plates: Column, *, corroborating: int = 2, pair_only_wells: int = 4, pair_only_plates: int = 2) -> Column:
    """Status ladder of a strain's consensus: monocultures decide, pair wells corroborate."""
    return (
        F.when(monos_agree >= 2, "ok_monos_agree")
        .when((monos_agree == 1) & (pair_wells >= corroborating), "ok_mono_plus_pairs")
        .when((monos_agree == 1) & (monos_seen >= 2), "monos_disagree")
        .when(monos_agree == 1, "mono_only")
        .when((monos_seen == 0) & (wells >= pair_only_wells) & (plates >= pair_only_plates), "ok_pairs_corroborated")
        .when(wells >= corroborating, "pairs_only_weak")
        .otherwise("single_well")
    )


def majority_status(top_wells: Column, informative: Column) -> Column:
    return F.when(informative == 0, "no_data").when(informative == 1, "ok_single_well").when(2 * top_wells > informative, "ok").otherwise("no_majority")


def composition(reads: DataFrame, *, well: str, group: str, expected: Column, min_reads: int = 2, min_share: float = 0.05) -> DataFrame:
    """Groups of a well with enough reads and share, and whether they are expected there."""
    counts = reads.groupBy(well, group).agg(F.count("*").alias("n"), F.bool_or(expected).alias("expected"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(well))
    return counts.withColumn("share", share).filter((F.col("n") >= min_reads) & (F.col("share") >= min_share))


def audit_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once: empty for a valid one-to-one side of a join."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join that raises when a key repeats on either side or a left row finds no partner."""
    a = left.withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    b = right.withColumn("_m", F.count("*").over(Window.partitionBy(*keys))).withColumn("_hit", F.lit(True))
    joined = a.join(b, keys, "left")
    bad = (F.col("_n") > 1) | (F.coalesce("_m", F.lit(1)) > 1) | F.col("_hit").isNull()
    guard = F.when(bad, F.raise_error(F.lit("the join is not one to one"))).otherwise(F.lit("ok"))
    return joined.withColumn("_guard", guard).filter(F.col("_guard") == "ok").drop("_n", "_m", "_hit", "_guard")
