"""Reads of wells into clusters, populations and consensus sequences, one well (or strain) in a task.

A well is bounded by the sequencing run: a few hundred to a few thousand reads.
``capped_reads`` is the sampling operator that holds a well to its cap; whatever
groups the functions below get are processed whole.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import consensus as C
from tessera.functions import pileup
from tessera.functions.draws import uniform

from .quality import consensus_status

LEN_LO, LEN_HI, READ_CAP = 1300, 1600, 800


def capped_reads(reads: DataFrame, *, by: str = "sample_id", cap: int = READ_CAP, low: int = LEN_LO, high: int = LEN_HI, seed: int = 0) -> DataFrame:
    """Reads within the length window, at most ``cap`` of each well, chosen by a seeded hash of their ids."""
    w = Window.partitionBy(by).orderBy(uniform(seed, by, "read_id"), "read_id")
    inside = reads.filter(F.length("seq").between(low, high))
    return inside.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= cap).drop("_n")


def top_quality(reads: DataFrame, n: int, *, by: str = "sample_id") -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc("q"), "read_id")
    return reads.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def read_distances(reads: DataFrame, *, by: str = "sample_id", most: int = 120) -> DataFrame:
    """(well, dist) of every couple among the first ``most`` reads of each well, normalised: the sample for the threshold."""
    from tessera.functions.sequence import norm_edit_distance

    w = Window.partitionBy(by).orderBy("read_id")
    few = reads.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most)
    a, b = few.select(by, F.col("_n").alias("_i"), F.col("seq").alias("_a")), few.select(by, F.col("_n").alias("_j"), F.col("seq").alias("_b"))
    return a.join(b, by).filter("_i < _j").select(by, norm_edit_distance(F.col("_a"), F.col("_b")).alias("dist"))


def cluster_wells(reads: DataFrame, threshold: float, *, by: str = "sample_id", min_reads: int = 3, min_frac: float = 0.10) -> DataFrame:
    """Per well: reads, strains (clusters of at least max(3, a tenth) reads), clusters, sizes, top and
    minority share, medoids of the strains.  Reads are taken in the order of their ids."""
    schema = f"{by} string, n_reads int, n_strains int, n_raw_clusters int, cluster_sizes array<int>, top_frac double, minority_frac double, representatives array<string>"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        seqs = pdf.sort_values("read_id")["seq"].tolist()
        n, clusters = len(seqs), C.greedy_clusters(seqs, threshold)
        strains = [c for c in clusters if len(c) >= max(min_reads, min_frac * n)]
        sizes = [len(c) for c in clusters]
        row = [str(pdf[by].iloc[0]), n, len(strains), len(clusters), sizes[:6], sizes[0] / n, sizes[1] / n if len(sizes) > 1 else 0.0, [C.medoid([seqs[i] for i in c]) for c in strains]]
        return pd.DataFrame([row], columns=[f.split(" ")[0] for f in schema.split(", ")])

    return reads.select(by, "read_id", "seq").groupBy(by).applyInPandas(run, schema)


def populations(reads: DataFrame, *, by: str = "sample_id") -> DataFrame:
    """(well, population, consensus, n_reads, frac, n_outliers): populations of oriented reads, largest first."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("read_id")
        found, outliers = C.well_populations(list(zip(pdf["seq"], pdf["q"], strict=True)))
        rows = [(str(pdf[by].iloc[0]), k, p["consensus"], p["n_reads"], p["frac"], outliers) for k, p in enumerate(found)]
        return pd.DataFrame(rows, columns=["well", "population", "consensus", "n_reads", "frac", "n_outliers"])

    return reads.select(by, "read_id", "seq", "q").groupBy(by).applyInPandas(run, "well string, population int, consensus string, n_reads int, frac double, n_outliers int")


def seeded_groups(reads: DataFrame, seeds: DataFrame, *, by: str = "sample_id", most: int = C.OUTLIER_BP) -> DataFrame:
    """(well, strain, n_reads, consensus): reads of a well given to their nearest seed within ``most``; ``seeds``: by, strain, seq."""

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        groups: dict[str, list[str]] = {}
        listed = list(zip(right["strain"], right["seq"], strict=True))
        for s in left.sort_values("read_id")["seq"] if listed else []:
            d, name = min((C.distance(s, seed), name) for name, seed in listed)
            if d <= most:
                groups.setdefault(name, []).append(s)
        rows = [(str(key[0]), name, len(m), C.majority_consensus(m)) for name, m in sorted(groups.items())]
        return pd.DataFrame(rows, columns=["well", "strain", "n_reads", "consensus"])

    left = reads.select(by, "read_id", "seq").groupBy(by)
    return left.cogroup(seeds.select(by, "strain", "seq").groupBy(by)).applyInPandas(run, "well string, strain string, n_reads int, consensus string")


def strain_consensus(representatives: DataFrame) -> DataFrame:
    """One row for each strain: clusters over its wells' representatives, status and consensus.

    ``representatives``: strain, seq, sample_id, well_type, plate, a row for each
    representative sequence.  Monocultures decide, then the number of wells."""
    schema = "strain string, informative_wells int, mono_wells_with_data int, monos_supporting int, pair_wells_supporting int, wells_supporting int, plates_supporting int, n_clusters int, second_cluster_wells int, consensus string"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["sample_id", "seq"])
        seeds: list[str] = []
        members: list[list[int]] = []
        for i, s in enumerate(pdf["seq"]):
            near = max(((1 - C.norm(s, seed), -k) for k, seed in enumerate(seeds)), default=(-1.0, 0))
            if near[0] >= C.CROSS_THR:
                members[-near[1]].append(i)
            else:
                seeds.append(s)
                members.append([i])
        parts = [pdf.iloc[m] for m in members]
        monos = [p.loc[p["well_type"] == "mono", "sample_id"].nunique() for p in parts]
        wells = [p["sample_id"].nunique() for p in parts]
        order = sorted(range(len(parts)), key=lambda k: (-monos[k], -wells[k], k))
        top = parts[order[0]]
        seen = pdf.loc[pdf["well_type"] == "mono", "sample_id"].nunique()
        row = [pdf["strain"].iloc[0], pdf["sample_id"].nunique(), seen, monos[order[0]], wells[order[0]] - monos[order[0]], wells[order[0]], top["plate"].nunique(), len(parts), wells[order[1]] if len(order) > 1 else 0, C.majority_consensus(top["seq"].tolist())]
        return pd.DataFrame([row], columns=[f.split(" ")[0] for f in schema.split(", ")])

    out = representatives.groupBy("strain").applyInPandas(run, schema)
    status = consensus_status(*map(F.col, ("monos_supporting", "mono_wells_with_data", "pair_wells_supporting", "wells_supporting", "plates_supporting")))
    return out.withColumns({"coverage": F.col("wells_supporting") / F.col("informative_wells"), "status": status})


def haplotypes(reads: DataFrame, consensus: DataFrame, *, by: str = "strain") -> DataFrame:
    """(strain, haplotype, seq, frac, pattern, n_sites) of reads against their strain's consensus; ``consensus``: by, consensus."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        seqs, base = pdf.sort_values("read_id")["seq"].tolist(), pdf["consensus"].iloc[0]
        sites = pileup.het_sites(base, seqs) or []
        rows = [(str(pdf[by].iloc[0]), k, s, frac, pattern, len(sites)) for k, (s, frac, pattern) in enumerate(pileup.haplotypes(base, sites, seqs))]
        return pd.DataFrame(rows, columns=["strain", "haplotype", "seq", "frac", "pattern", "n_sites"])

    both = reads.select(by, "read_id", "seq").join(consensus.select(by, "consensus"), by)
    return both.groupBy(by).applyInPandas(run, "strain string, haplotype int, seq string, frac double, pattern string, n_sites int")


def tiled_hits(hits: DataFrame, by: list[str]) -> DataFrame:
    """(by, n_hits, covered): best-first non-overlapping intervals of each group; ``hits``: start, end, score."""
    kinds = dict(hits.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in by) + ", n_hits int, covered long"

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        kept = C.tile(list(zip(pdf["start"], pdf["end"], pdf["score"], strict=True)))
        return pd.DataFrame([(*key, len(kept), sum(e - s for s, e, _ in kept))], columns=[*by, "n_hits", "covered"])

    return hits.select(*by, "start", "end", "score").groupBy(*by).applyInPandas(run, schema)


def composition_summary(wells: DataFrame) -> DataFrame:
    """By well type: wells, share with 1, 2, 3 and 4 or more strains, quantiles of the minority share."""
    n = F.least("n_strains", F.lit(4))
    x = "minority_frac"
    return wells.groupBy("well_type").agg(
        F.count("*").alias("wells"),
        *[F.avg((n == k).cast("double")).alias(f"share_{k}") for k in (1, 2, 3, 4)],
        *[F.percentile(x, F.lit(q)).alias(f"minority_p{int(q * 100)}") for q in (0.5, 0.75, 0.9)],
        *[F.avg((F.col(x) >= t).cast("double")).alias(f"at_least_{int(t * 100)}pct") for t in (0.2, 0.1, 0.05, 0.02)],
    )
