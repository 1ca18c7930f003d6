"""Whole analyses as chains of operators: lazily built, one plan from reads to verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.sequence import norm_edit_distance
from tessera.operators import identity, models, pairs, quality, scoring, stats, wells
from tessera.sources import sequences, tabular
from tessera.storage import materialize

#: Below this distance a name's sequences in two databases agree; below the second an unexpected strain is a twin of the expected (fixed values).
CROSS_CHECK, TWIN = 0.02, 0.02


def reference_coverage(layout: DataFrame, databases: dict[str, DataFrame]) -> DataFrame:
    """(strain, db, len): every strain of the layout in every database, null where it is missing."""
    strains = layout.select(F.explode(F.array("strain1", "strain2")).alias("strain")).filter("strain <> ''").distinct()
    out = None
    for name, db in databases.items():
        own = strains.join(db.select(F.col("name").alias("strain"), F.length("seq").alias("len")), "strain", "left").select("strain", F.lit(name).alias("db"), "len")
        out = own if out is None else out.unionByName(own)
    return out


def cross_check(primary: DataFrame, others: dict[str, DataFrame]) -> DataFrame:
    """(strain, db, dist, reliable) of each further database against the primary one, all of them."""
    out = None
    for name, db in others.items():
        both = primary.select(F.col("name").alias("strain"), F.col("seq").alias("_a")).join(db.select(F.col("name").alias("strain"), F.col("seq").alias("_b")), "strain")
        d = norm_edit_distance(F.col("_a"), F.col("_b"))
        own = both.select("strain", F.lit(name).alias("db"), d.alias("dist"), (d < CROSS_CHECK).alias("reliable"))
        out = own if out is None else out.unionByName(own)
    return out


def interaction_scores(layout: DataFrame, reads: DataFrame, references: DataFrame, *, types: tuple[str, ...] = ("pair",), threshold: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(wells, reads): distances to both references, calls, scores and canonical outcomes of two-strain wells.

    Distances are the expensive part and are written once.  The off-target threshold
    is learned from them unless given.  Wells that lack a reference stay, flagged."""
    two = layout.filter(F.col("well_type").isin(*types)).select("sample_id", "well_type", "strain1", "strain2")
    ref = identity.checked(references.select("name", "seq"))
    named = two
    for k in (1, 2):
        named = named.join(ref.select(F.col("name").alias(f"strain{k}"), F.col("seq").alias(f"_{k}")), f"strain{k}", "left")
    have = F.col("_1").isNotNull() & F.col("_2").isNotNull()
    d = reads.select("sample_id", "read_id", "seq").join(named.filter(have), "sample_id")
    bp = {k: F.levenshtein("seq", f"_{k}") for k in (1, 2)}
    d = d.select("sample_id", "read_id", *[bp[k].alias(f"b{k}") for k in (1, 2)], *[F.try_divide(bp[k], F.greatest(F.length("seq"), F.length(f"_{k}"))).alias(f"d{k}") for k in (1, 2)])
    d = materialize(d, "distances")
    if threshold is None:
        threshold = stats.valley_threshold(d.select(F.least("d1", "d2").alias("d")), "d", lo=0.04, hi=0.2)
    called = d.withColumn("read_class", scoring.read_class(F.col("d1"), F.col("d2"), F.col("b1"), F.col("b2"), F.lit(threshold)))
    scores = scoring.score_wells(called, by=["sample_id"])
    far = F.levenshtein("_1", "_2")
    out = named.select("sample_id", "well_type", "strain1", "strain2", (~have).alias("missing_reference"), far.alias("ref_pair_bp_dist")).join(scores, "sample_id", "left")
    return pairs.canonical(out), called


def contamination(universe: DataFrame, layout: DataFrame, hits: dict[str, DataFrame]) -> DataFrame:
    """Best-hit summaries of every database, keyed by ``db``.  ``hits``: alignments by database."""
    out = None
    for name, paf in hits.items():
        table = tabular.best_hit_table(universe, paf, layout)
        own = quality.best_hit_summary(table, by="sample_id", hit="best_hit_strain", expected=F.col("is_expected")).withColumn("db", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return out


def combine_and_flag(samples: DataFrame, confident: DataFrame, best_hits: DataFrame, references: DataFrame) -> DataFrame:
    """Wells with status and contamination flag, and whether the unexpected strain is a twin of an expected one.

    ``samples``: sample_id, well_type, strain1, strain2, n_reads; ``confident`` and
    ``best_hits`` of the primary database, one row a sample."""
    hits = best_hits.select("sample_id", "frac_expected", "frac_unmapped", "top_other", "top_other_count", "top_other_frac")
    x = samples.join(confident, "sample_id", "left").join(hits, "sample_id", "left")
    x = x.withColumns(
        {
            "qc_cutoff_reads": quality.read_cutoff(F.col("n_reads")),
            "qc_status": quality.qc_status(*map(F.col, ("well_type", "n_reads", "n_conf_strain1", "n_conf_strain2"))),
            "qc_contaminated": quality.contaminated(F.col("top_other_frac"), F.col("top_other_count")),
        }
    )
    ref = identity.checked(references.select("name", "seq"))
    for col in ("top_other", "strain1", "strain2"):
        x = x.join(ref.select(F.col("name").alias(col), F.col("seq").alias(f"_{col}")), col, "left")
    near = F.least(*[norm_edit_distance(F.col(f"_{s}"), F.col("_top_other")) for s in ("strain1", "strain2")])
    return x.withColumn("contaminant_dist", near).withColumn("likely_twin", near < TWIN).drop("_top_other", "_strain1", "_strain2")


def hierarchy(scored: DataFrame) -> dict[str, DataFrame]:
    """Pair statistics, competitiveness, strengths with residuals, and the order's consistency, of scored wells."""
    known = scored.filter("NOT missing_reference")
    stats_ = scoring.replicate_stability(known, bp_col="ref_pair_bp_dist")
    pooled = scoring.pooled_counts(known)
    main = scoring.main_component(pooled)
    strengths = models.fit_bradley_terry(scoring.in_component(pooled, main))
    inside = scoring.in_component(stats_, main)
    edges = scoring.win_edges(inside, F.col("mean_relative_abundance_a"))
    return {
        "pairs": stats_,
        "competitiveness": scoring.competitiveness(stats_),
        "strengths": strengths.join(models.strength_residuals(inside, strengths), "strain", "left"),
        "fit": models.goodness_of_fit(strengths),
        "consistency": scoring.directional_consistency(edges, scoring.win_ranks(edges, main)),
        "triads": scoring.intransitive_triads(edges),
    }


def composition(reads: DataFrame, layout: DataFrame, *, min_reads: int = 5, threshold: float | None = None) -> DataFrame:
    """Clusters of every well with enough reads, at a threshold learned from couples of reads unless given."""
    inside = wells.capped_reads(reads)
    if threshold is None:
        threshold = stats.valley_threshold(wells.read_distances(inside), "dist", lo=0.03, hi=0.15, empty_frac=0.001, top=0.4, fallback=0.08)
    enough = inside.groupBy("sample_id").agg(F.count("*").alias("n")).filter(F.col("n") > min_reads).select("sample_id")
    return wells.cluster_wells(inside.join(enough, "sample_id", "left_semi"), threshold).join(layout, "sample_id", "left")


def consensus_of(clustered: DataFrame) -> DataFrame:
    """Consensus by strain from the representatives of :func:`composition`; a monoculture counts once."""
    strains = F.explode(F.array_distinct(F.filter(F.array("strain1", "strain2"), lambda s: s.isNotNull() & (s != "")))).alias("strain")
    rows = clustered.select(strains, "sample_id", "well_type", F.col("dest_plate").alias("plate"), F.explode("representatives").alias("seq"))
    return wells.strain_consensus(rows)


def identity_of(consensus: DataFrame, references: DataFrame, *, floor: float = 0.01) -> DataFrame:
    """Verdicts of consensus sequences against a reference collection."""
    q = consensus.select(F.col("strain").alias("name"), F.col("consensus").alias("seq"))
    twin = identity.twins(identity.distances(references, references), floor)
    return identity.verdicts(identity.distances(q, references), q.select(F.col("name").alias("query"), F.col("name").alias("expected")), twin, references)


def read_run(spark, layout_path: str, reads_path: str, *, min_reads: int = 5) -> tuple[DataFrame, DataFrame]:
    """(wells of the cohort, their reads) of a run's layout and folder of reads."""
    reads = sequences.read_fastq(spark, reads_path)
    listed = sequences.well_paths(sequences.read_layout(spark, layout_path), reads.select("path").distinct())
    cohort = sequences.cohort(listed, reads.groupBy("path").agg(F.count("*").alias("n_reads")), min_reads=min_reads)
    return cohort, reads.join(cohort.select("sample_id", "path"), "path").drop("path")
