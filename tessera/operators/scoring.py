"""From read distances to well scores, pair statistics and a dominance hierarchy."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import connected_components
from .pairs import both_orientations


@dataclass(frozen=True)
class Limits:
    """Thresholds of scoring and of replicate flags (fixed values)."""

    ambiguous_margin_bp: float = 1.0
    min_resolvable_bp: float = 10.0
    high_uncertainty: float = 0.3
    unstable_sd: float = 0.15


LIMITS = Limits()


def read_class(d1_norm: Column, d2_norm: Column, b1: Column, b2: Column, off_target: Column | float, limits: Limits = LIMITS) -> Column:
    """Off target if the nearer reference is too far (normalised distance), ambiguous if
    the distances in bp differ by less than the margin, else the nearer strain."""
    return (
        F.when(F.least(d1_norm, d2_norm) > off_target, "off_target")
        .when(F.abs(b1 - b2) < limits.ambiguous_margin_bp, "ambiguous")
        .when(b1 < b2, "strain1")
        .otherwise("strain2")
    )


def score_wells(reads: DataFrame, *, by: list[str], class_col: str = "read_class") -> DataFrame:
    """Counts of the four read classes by well and the scores made of them; 0 denominators give null.

    One aggregation with conditional counts: what is shuffled is one row for each well and task."""
    n = {c: F.count_if(F.col(class_col) == c) for c in ("strain1", "strain2", "ambiguous", "off_target")}
    counts = reads.groupBy(*by).agg(F.count("*").alias("n_reads"), *[v.alias(f"n_{c}") for c, v in n.items()])
    return well_scores(counts)


def well_scores(counts: DataFrame) -> DataFrame:
    n1, n2, amb = F.col("n_strain1"), F.col("n_strain2"), F.col("n_ambiguous")
    on = n1 + n2 + amb
    return counts.withColumns(
        {
            "n_on_target": on,
            "off_target_frac": F.try_divide("n_off_target", "n_reads"),
            "uncertainty_score": F.try_divide(amb, on),
            "relative_abundance_strain1": F.try_divide(n1 + 0.5 * amb, on),
            "relative_abundance_strain1_confident": F.try_divide(n1, n1 + n2),
            "log2_ratio_strain1_over_strain2": F.log2((n1 + 0.5) / (n2 + 0.5)),
        }
    )


def replicate_stability(wells: DataFrame, *, bp_col: str | None = None, limits: Limits = LIMITS) -> DataFrame:
    """One row for each pair: means, spread (null for a single well) and the three flags."""
    several = F.count("*") > 1
    bp = F.first(bp_col, ignorenulls=True) if bp_col else F.lit(None).cast("double")
    stats = wells.groupBy("strain_a", "strain_b").agg(
        F.count("*").alias("n_replicates"),
        bp.alias("ref_pair_bp_dist"),
        F.avg("n_reads").alias("mean_n_reads"),
        F.avg("relative_abundance_a").alias("mean_relative_abundance_a"),
        F.stddev_samp("relative_abundance_a").alias("std_relative_abundance_a"),
        F.when(several, F.max("relative_abundance_a") - F.min("relative_abundance_a")).alias("range_relative_abundance_a"),
        F.avg("log2_ratio_a_over_b").alias("mean_log2_ratio_a_over_b"),
        F.stddev_samp("log2_ratio_a_over_b").alias("std_log2_ratio_a_over_b"),
        F.avg("uncertainty_score").alias("mean_uncertainty_score"),
        F.avg("off_target_frac").alias("mean_off_target_frac"),
    )
    below = F.coalesce(F.col("ref_pair_bp_dist") < limits.min_resolvable_bp, F.lit(False))
    return stats.withColumns(
        {
            "below_resolution_limit": below,
            "high_uncertainty_pair": below | F.coalesce(F.col("mean_uncertainty_score") > limits.high_uncertainty, F.lit(False)),
            "unstable_replicate": F.coalesce(F.col("std_relative_abundance_a") > limits.unstable_sd, F.lit(False)),
        }
    )


def competitiveness(pairs: DataFrame, strains: DataFrame | None = None) -> DataFrame:
    """One row for each strain over both orientations of its pairs; strains without a pair keep n_opponents 0."""
    seen = both_orientations(pairs, keep=("n_replicates", "high_uncertainty_pair"))
    out = seen.groupBy("strain").agg(
        F.count("*").alias("n_opponents"),
        F.sum("n_replicates").alias("n_wells"),
        F.avg("ratio_self").alias("competitiveness_score"),
        F.stddev_samp("ratio_self").alias("sd_log2_ratio"),
        F.avg("share_self").alias("mean_relative_abundance"),
        F.avg((F.col("share_self") > 0.5).cast("double")).alias("win_fraction"),
        F.avg(F.col("high_uncertainty_pair").cast("double")).alias("frac_high_uncertainty_opponents"),
    )
    if strains is None:
        return out
    return strains.select("strain").distinct().join(out, "strain", "left").na.fill(0, ["n_opponents", "n_wells"])


def pooled_counts(wells: DataFrame) -> DataFrame:
    """Reads of either member summed by pair, oriented to a < b; pairs without a read are left out."""
    straight = F.col("strain1") == F.col("strain_a")
    a = F.when(straight, F.col("n_strain1")).otherwise(F.col("n_strain2"))
    b = F.when(straight, F.col("n_strain2")).otherwise(F.col("n_strain1"))
    sums = wells.groupBy("strain_a", "strain_b").agg(F.sum(a).alias("n_reads_a"), F.sum(b).alias("n_reads_b"))
    return sums.filter(F.col("n_reads_a") + F.col("n_reads_b") > 0)


def outcome(share: Column) -> Column:
    """1 for a win, 0 for a loss, 0.5 for a tie, null if unknown."""
    return F.when(share > 0.5, 1.0).when(share < 0.5, 0.0).when(share == 0.5, 0.5)


#: Mean shares this near to a half are ties: a mean of fractions is off by its last bits, depending on the order they were added in.
TIE = 1e-12


def win_edges(pairs: DataFrame, share: Column) -> DataFrame:
    """``strain_a < strain_b`` and ``a_wins`` of the pairs that are decided; ties (within ``TIE``) and unknown outcomes are no edge."""
    exact = F.when(F.abs(share - 0.5) <= TIE, 0.5).otherwise(share)
    return pairs.withColumn("_w", outcome(exact)).filter("_w IN (0.0, 1.0)").select("strain_a", "strain_b", (F.col("_w") == 1.0).alias("a_wins"))


def win_ranks(edges: DataFrame, strains: DataFrame | None = None) -> DataFrame:
    """(strain, wins, rank from 0): most wins first, ties by name."""
    seen = edges.select(F.explode(F.array(F.struct(F.col("strain_a").alias("s"), F.col("a_wins").alias("w")), F.struct(F.col("strain_b").alias("s"), (~F.col("a_wins")).alias("w")))).alias("x"))
    wins = seen.groupBy(F.col("x.s").alias("strain")).agg(F.count_if("x.w").alias("wins"))
    if strains is not None:
        wins = strains.select("strain").distinct().join(wins, "strain", "left").na.fill(0, ["wins"])
    # strains are a dimension of an experiment: a few thousand at most, so one ordered window is bounded
    return wins.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("wins"), "strain")) - 1)


def directional_consistency(edges: DataFrame, ranks: DataFrame) -> DataFrame:
    """One row: (consistent - upsets) / decided, and the two counts."""
    a = ranks.select(F.col("strain").alias("strain_a"), F.col("rank").alias("rank_a"))
    b = ranks.select(F.col("strain").alias("strain_b"), F.col("rank").alias("rank_b"))
    agree = F.col("a_wins") == (F.col("rank_a") < F.col("rank_b"))
    sums = edges.join(a, "strain_a").join(b, "strain_b").agg(F.count_if(agree).alias("n_consistent"), F.count_if(~agree).alias("n_inconsistent"))
    return sums.withColumn("dci", F.try_divide(F.col("n_consistent") - F.col("n_inconsistent"), F.col("n_consistent") + F.col("n_inconsistent")))


def intransitive_triads(edges: DataFrame) -> DataFrame:
    """One row: triples with three decided edges, and how many of them are cycles.

    No triple is made.  Strains are numbered and their neighbours kept as bits, 64
    to a row; over all edges the common neighbours of both ends count each triple
    three times, and those that the loser beats and that beat the winner count each
    cycle three times.  So the work is edges times words, not edges times neighbours."""
    # a number for each strain, a dimension of the experiment
    strains = edges.select(F.explode(F.array("strain_a", "strain_b")).alias("s")).distinct()
    number = strains.withColumn("i", F.row_number().over(Window.orderBy("s")).cast("long") - 1)
    at = lambda c, name: number.select(F.col("s").alias(c), F.col("i").alias(name))
    placed = edges.join(at("strain_a", "a"), "strain_a").join(at("strain_b", "b"), "strain_b")
    beats = placed.select(F.when(F.col("a_wins"), F.col("a")).otherwise(F.col("b")).alias("w"), F.when(F.col("a_wins"), F.col("b")).otherwise(F.col("a")).alias("l"))
    seen = beats.select(F.explode(F.array(F.struct(F.col("w").alias("v"), F.col("l").alias("o"), F.lit(True).alias("beat")), F.struct(F.col("l").alias("v"), F.col("w").alias("o"), F.lit(False).alias("beat")))).alias("x")).select("x.*")
    bit = F.expr("shiftleft(CAST(1 AS BIGINT), CAST(o % 64 AS INT))")
    none = F.lit(0).cast("long")
    words = seen.groupBy("v", F.floor(F.col("o") / 64).alias("word")).agg(F.coalesce(F.bit_or(F.when(F.col("beat"), bit)), none).alias("out"), F.coalesce(F.bit_or(F.when(~F.col("beat"), bit)), none).alias("in"))
    side = lambda v: words.select(F.col("v").alias(v), "word", F.col("out").alias(f"{v}_out"), F.col("in").alias(f"{v}_in"))
    both = beats.join(side("w"), "w").join(side("l"), ["l", "word"])
    common = F.bit_count((F.col("w_out").bitwiseOR(F.col("w_in"))).bitwiseAND(F.col("l_out").bitwiseOR(F.col("l_in"))))
    cycles = F.bit_count(F.col("l_out").bitwiseAND(F.col("w_in")))
    third = lambda c: F.coalesce(F.sum(c) / 3, F.lit(0.0)).cast("long")
    sums = both.agg(third(common).alias("n_triads"), third(cycles).alias("n_cyclic"))
    return sums.withColumn("cyclic_frac", F.try_divide("n_cyclic", "n_triads"))


def main_component(pairs: DataFrame, a: str = "strain_a", b: str = "strain_b") -> DataFrame:
    """(strain) of the largest connected component; of equally large ones that with the smallest member."""
    members = connected_components(pairs, a, b)
    sizes = members.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return members.join(sizes.select("component"), "component", "left_semi").select(F.col("vertex").alias("strain"))


def in_component(pairs: DataFrame, members: DataFrame, a: str = "strain_a", b: str = "strain_b") -> DataFrame:
    return pairs.join(members.select(F.col("strain").alias(a)), a, "left_semi").join(members.select(F.col("strain").alias(b)), b, "left_semi").select(pairs.columns)
