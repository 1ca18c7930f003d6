"""Isolates, genomes and who carries whose sequence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import connected_components
from .quality import genome_call


def resolve_isolates(stock: DataFrame, sheet: DataFrame) -> DataFrame:
    """(well, isolate, source, n_wells): the stock's number, else the alternative name, else the first number in the label.

    ``stock``: well, strain_number, label; ``sheet``: strain_number, alternative_name."""
    joined = stock.join(sheet.select("strain_number", "alternative_name"), "strain_number", "left")
    number = F.nullif(F.regexp_extract("label", r"(M\d+)", 1), F.lit(""))
    isolate = F.coalesce(F.col("alternative_name"), F.col("strain_number").cast("string"), number)
    source = F.when(F.col("alternative_name").isNotNull(), "alternative").when(F.col("strain_number").isNotNull(), "number").when(number.isNotNull(), "label")
    return joined.select("well", isolate.alias("isolate"), source.alias("source")).withColumn("n_wells", F.when(F.col("isolate").isNotNull(), F.count("*").over(Window.partitionBy("isolate"))))


def duplicate_isolates(wells: DataFrame) -> DataFrame:
    """(isolate, a, b, state) of couples of wells of one isolate: same clone, another clone, or unverified.

    ``wells``: well, isolate, clone_cluster (null without a genome)."""
    side = lambda k: wells.select("isolate", F.col("well").alias(k), F.col("clone_cluster").alias(f"c{k}"))
    both = side("a").join(side("b"), "isolate").filter("a < b")
    state = F.when(F.col("ca").isNull() | F.col("cb").isNull(), "unverified").when(F.col("ca") == F.col("cb"), "holds").otherwise("other")
    return both.select("isolate", "a", "b", state.alias("state"))


def genome_verdicts(strains: DataFrame, hits: DataFrame, clones: DataFrame) -> DataFrame:
    """(strain, own_call, carriers, clone_vouches, status).

    ``strains``: strain; ``hits``: strain, genome, dist (normalised); ``clones``: well, clone_cluster.
    A genome carries a strain's sequence if its call is a match.  Status: ``verified``
    (its own genome matches), ``vouched`` (a clone of its genome matches),
    ``wrong_genome`` (its own mismatches and another carries it), ``contradicted``
    (its own mismatches, nobody carries it), ``ambiguous``, ``no_genome``."""
    calls = hits.withColumn("call", genome_call(F.col("dist")))
    own = calls.filter("strain = genome").groupBy("strain").agg(F.min("dist").alias("own_dist"))
    carriers = calls.filter("call = 'match'").groupBy("strain").agg(F.sort_array(F.collect_set("genome")).alias("carriers"))
    mine = clones.select(F.col("well").alias("strain"), F.col("clone_cluster").alias("_c"))
    mates = clones.select(F.col("well").alias("genome"), F.col("clone_cluster").alias("_c"))
    vouched = calls.filter("call = 'match' AND strain <> genome").join(mine, "strain").join(mates, ["genome", "_c"]).select("strain").distinct().withColumn("clone_vouches", F.lit(True))
    out = strains.select("strain").join(own, "strain", "left").join(carriers, "strain", "left").join(vouched, "strain", "left")
    out = out.withColumns({"own_call": genome_call(F.col("own_dist")), "clone_vouches": F.coalesce("clone_vouches", F.lit(False)), "carriers": F.coalesce("carriers", F.array().cast("array<string>"))})
    status = (
        F.when(F.col("own_call") == "match", "verified")
        .when(F.col("clone_vouches"), "vouched")
        .when((F.col("own_call") == "mismatch") & (F.size("carriers") > 0), "wrong_genome")
        .when(F.col("own_call") == "mismatch", "contradicted")
        .when(F.col("own_call") == "ambiguous", "ambiguous")
        .otherwise("no_genome")
    )
    return out.withColumn("status", status).drop("own_dist")


def cv_groups(wells: DataFrame) -> DataFrame:
    """(well, cv_group): components of the graph of wells, their genome units and the units that invaded them.

    ``wells``: well, genome_unit, is_of (null where a well holds what it should)."""
    key = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    edges = wells.select(F.explode(F.array(F.struct(key("w:", "well").alias("a"), key("u:", "genome_unit").alias("b")), F.struct(key("w:", "well").alias("a"), key("u:", "is_of").alias("b")))).alias("e")).select("e.a", "e.b")
    alone = wells.select(key("w:", "well").alias("a"), key("w:", "well").alias("b"))
    found = connected_components(edges.unionByName(alone), "a", "b")
    return found.filter("vertex LIKE 'w:%'").select(F.substring("vertex", 3, 1 << 20).alias("well"), F.col("component").alias("cv_group"))


def eligible_units(strains: DataFrame) -> DataFrame:
    """One representative for each genomic unit: better tier, more competitive, then name; with its mates.

    ``strains``: strain, unit, tier (high, medium), competing double."""
    order = F.struct(F.when(F.col("tier") == "high", 0).otherwise(1).alias("t"), (-F.coalesce("competing", F.lit(0.0))).alias("c"), F.col("strain").alias("s"))
    out = strains.groupBy("unit").agg(F.min_by("strain", order).alias("strain"), F.sort_array(F.collect_set("strain")).alias("_all"))
    return out.select("unit", "strain", F.array_except("_all", F.array("strain")).alias("mates"))


def kmer_candidates(reads: DataFrame, references: DataFrame, *, k: int = 11, top: int = 5) -> DataFrame:
    """(read_id, ref, shared): references that share most k-mers with a read: what an edit distance is worth computing for.

    Meets reads and references at common k-mers only; k-mers found in more than
    half of the references, which tell nothing apart, are left out."""
    mers = lambda seq: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(seq) - k + 1, F.lit(1))), lambda i: F.substring(seq, i, F.lit(k))))
    r = references.select(F.col("name").alias("ref"), F.explode(mers(F.col("seq"))).alias("mer"))
    n = references.count()
    common = r.groupBy("mer").agg(F.count("*").alias("_n")).filter(F.col("_n") > max(1, n // 2)).select("mer")
    r = r.join(common, "mer", "left_anti")
    hits = reads.select("read_id", F.explode(mers(F.col("seq"))).alias("mer")).join(r, "mer").groupBy("read_id", "ref").agg(F.count("*").alias("shared"))
    place = F.row_number().over(Window.partitionBy("read_id").orderBy(F.desc("shared"), "ref"))
    return hits.withColumn("_n", place).filter(F.col("_n") <= top).drop("_n")


def races(reads: DataFrame, references: DataFrame, neighbours: DataFrame) -> DataFrame:
    """(strain, rival, n, correct, tied, wrong): reads of a strain raced between its own reference and each close one.

    ``reads``: strain, seq; ``neighbours``: strain, rival."""
    ref = references.select("name", "seq")
    both = reads.select("strain", F.col("seq").alias("_r")).join(neighbours, "strain")
    both = both.join((ref.select(F.col("name").alias("strain"), F.col("seq").alias("_own"))), "strain").join((ref.select(F.col("name").alias("rival"), F.col("seq").alias("_riv"))), "rival")
    d = both.withColumn("_d", F.levenshtein("_r", "_riv") - F.levenshtein("_r", "_own"))
    return d.groupBy("strain", "rival").agg(F.count("*").alias("n"), F.count_if(F.col("_d") > 0).alias("correct"), F.count_if(F.col("_d") == 0).alias("tied"), F.count_if(F.col("_d") < 0).alias("wrong"))
