"""Tables of aligners, annotators, sequencers and experiment sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.sequence import reverse_complement

PAF = "qname string, qlen int, qstart int, qend int, strand string, tname string, tlen int, tstart int, tend int, nmatch int, alnlen int, mapq int"
BLAST = "qseqid string, sseqid string, pident double, length int, qlen int, mismatch int, gaps int, qstart int, qend int, bitscore double"
ANI = "Ref_file string, Query_file string, ANI double, Align_fraction_ref double, Align_fraction_query double"
GFF = "seqid string, source string, type string, start int, end int, score string, strand string, phase string, attributes string"
SUMMARY = ["read_id", "channel", "start_time", "duration", "passes_filtering", "sequence_length_template", "mean_qscore_template", "end_reason"]


def read_paf(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The twelve fixed fields and ``identity``; an empty file gives an empty table."""
    return spark.read.csv(path, sep="\t", schema=PAF, quote="").withColumn("identity", F.try_divide("nmatch", "alnlen"))


def best_alignments(paf: DataFrame) -> DataFrame:
    """One alignment for each query: most matches, then identity, then target name."""
    return paf.groupBy("qname").agg(F.max_by(F.struct("*"), F.struct("nmatch", "identity", F.col("tname"))).alias("b")).select("b.*")


def best_hit_table(universe: DataFrame, paf: DataFrame, wells: DataFrame) -> DataFrame:
    """Every read of the universe with its best hit; unmapped: null hit, zero matches; expected if the hit is one of the well's strains.

    Query names are ``sample__read``."""
    hits = best_alignments(paf).select(F.split("qname", "__")[0].alias("sample_id"), F.split("qname", "__")[1].alias("read_id"), F.col("tname").alias("best_hit_strain"), "nmatch", "alnlen", "identity", "mapq")
    out = universe.join(hits, ["sample_id", "read_id"], "left").join(wells.select("sample_id", "strain1", "strain2"), "sample_id", "left")
    expected = F.coalesce((F.col("best_hit_strain") == F.col("strain1")) | (F.col("best_hit_strain") == F.col("strain2")), F.lit(False))
    return out.na.fill(0, ["nmatch", "alnlen", "mapq"]).na.fill(0.0, ["identity"]).withColumn("is_expected", expected)


def read_blast(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Tabular hits with ``diffs`` and the genome, the subject up to ``|``."""
    raw = spark.read.csv(path, sep="\t", schema=BLAST, quote="", comment="#")
    return raw.withColumns({"diffs": F.col("mismatch") + F.col("gaps"), "genome": F.split("sseqid", r"\|")[0]})


def read_ani(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(well_a, well_b, ani, af_a, af_b) with well_a < well_b; fractions swap along; self-comparisons are left out."""
    raw = spark.read.csv(path, sep="\t", schema=ANI, header=True)
    well = lambda c: F.regexp_extract(c, r"([^/]+?)(\.f(ast|n)?a)?$", 1)
    a, b = well(F.col("Ref_file")), well(F.col("Query_file"))
    flip = a > b
    fa, fb = F.col("Align_fraction_ref"), F.col("Align_fraction_query")
    out = raw.select(F.least(a, b).alias("well_a"), F.greatest(a, b).alias("well_b"), F.col("ANI").alias("ani"), F.when(flip, fb).otherwise(fa).alias("af_a"), F.when(flip, fa).otherwise(fb).alias("af_b"))
    return out.filter("well_a <> well_b")


def clone_clusters(ani: DataFrame, *, limit: float = 99.9) -> DataFrame:
    """(well, clone_cluster): components at ``limit`` ANI or more, numbered from 1 by size, then smallest member."""
    from pyspark.sql import Window

    from tessera.operators.graph import connected_components

    members = connected_components(ani.filter(F.col("ani") >= limit), "well_a", "well_b")
    sizes = members.groupBy("component").agg(F.count("*").alias("n"))
    numbered = sizes.withColumn("clone_cluster", F.row_number().over(Window.orderBy(F.desc("n"), "component")))
    return members.join(numbered, "component").select(F.col("vertex").alias("well"), "clone_cluster", "n")


def read_gff_genes(spark: SparkSession, path: str | list[str], contigs: DataFrame, *, product: str = "16S_rRNA", least: int = 400) -> DataFrame:
    """(seqid, start, end, strand, seq) of genes of a product, cut from ``contigs`` (seqid, seq), reverse strand complemented."""
    genes = spark.read.csv(path, sep="\t", schema=GFF, comment="#", quote="").filter(F.contains("attributes", F.lit(product)))
    cut = genes.join(contigs.select("seqid", F.col("seq").alias("_c")), "seqid")
    part = F.substring(F.col("_c"), F.col("start"), F.col("end") - F.col("start") + 1)
    return cut.withColumn("seq", F.when(F.col("strand") == "-", reverse_complement(part)).otherwise(part)).filter(F.length("seq") >= least).select("seqid", "start", "end", "strand", "seq")


def read_sequencing_summary(spark: SparkSession, path: str | list[str], run: str) -> DataFrame:
    """Eight columns of a sequencing summary, renamed, with the run's name; the scan reads no others."""
    raw = spark.read.csv(path, sep="\t", header=True)
    return raw.select(
        "read_id", F.col("channel").cast("int").alias("channel"), F.col("start_time").cast("double").alias("start_s"), F.col("duration").cast("double").alias("duration_s"),
        (F.lower("passes_filtering") == "true").alias("passed"), F.col("sequence_length_template").cast("int").alias("length"), F.col("mean_qscore_template").cast("double").alias("q"), "end_reason", F.lit(run).alias("run"),
    )


def pore_occupancy(activity: DataFrame) -> DataFrame:
    """(minute, occupancy): strand and adapter over all usable states; null without a usable pore.  ``activity``: state, minute, samples."""
    state = lambda *s: F.sum(F.when(F.col("state").isin(*s), F.col("samples")).otherwise(0))
    return activity.groupBy("minute").agg(F.try_divide(state("strand", "adapter"), state("strand", "adapter", "pore")).alias("occupancy"))


def read_minibar_sheet(spark: SparkSession, path: str | list[str], *, barcode_bp: int = 24) -> DataFrame:
    """(sample_id, fwd_barcode, rev_barcode): the last ``barcode_bp`` letters of either index column."""
    raw = spark.read.csv(path, sep="\t", header=True)
    return raw.select(F.col("SampleID").alias("sample_id"), F.right("FwIndex", F.lit(barcode_bp)).alias("fwd_barcode"), F.right("RvIndex", F.lit(barcode_bp)).alias("rev_barcode"))


def read_demux_counts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(sample_id, n_reads) from ``sample`` and ``read_count`` or ``reads``."""
    raw = spark.read.csv(path, sep="\t", header=True)
    n = next(c for c in ("read_count", "reads") if c in raw.columns)
    return raw.select(F.col("sample").alias("sample_id"), F.col(n).cast("long").alias("n_reads"))


def read_feature_table(spark: SparkSession, path: str | list[str], *, keep: list[str] | None = None) -> DataFrame:
    """(strain, feature, cnt) of the non-zero cells of a wide table whose first column names the strain."""
    raw = spark.read.csv(path, header=True)
    columns = [(k, c) for k, c in enumerate(raw.columns) if k and (keep is None or c in keep)]
    raw = raw.toDF(*[f"_{k}" for k in range(len(raw.columns))])
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"_{k}").cast("double").alias("cnt")) for k, c in columns])
    return raw.select(F.col("_0").alias("strain"), F.explode(F.filter(cells, lambda x: x["cnt"] != 0)).alias("x")).select("strain", "x.feature", "x.cnt")


def read_distance_matrix(spark: SparkSession, path: str | list[str], names: list[str] | None = None) -> DataFrame:
    """(a, b, d) of a square matrix with names in its first column and header, restricted to ``names`` on both sides."""
    raw = spark.read.csv(path, header=True)
    columns = [(k, c) for k, c in enumerate(raw.columns) if k and (names is None or c in names)]
    raw = raw.toDF(*[f"_{k}" for k in range(len(raw.columns))])  # names may repeat those of the result
    cells = F.array(*[F.struct(F.lit(c).alias("b"), F.col(f"_{k}").cast("double").alias("d")) for k, c in columns])
    out = raw.select(F.col("_0").alias("a"), F.explode(cells).alias("x")).select("a", "x.b", "x.d")
    return out if names is None else out.filter(F.col("a").isin(names))


def read_mapping(spark: SparkSession, path: str | list[str], *, key: str, value: str) -> DataFrame:
    """(key, value) pairs of a sheet; raises when a key has two values."""
    rows = spark.read.csv(path, header=True).select(F.col(f"`{key}`").alias("key"), F.col(f"`{value}`").alias("value")).dropna().distinct()
    if not rows.groupBy("key").count().filter("count > 1").isEmpty():
        raise ValueError(f"{key} is not unique in {path}")
    return rows


def write_partitioned_csv(df: DataFrame, path: str, by: list[str]) -> DataFrame:
    """A CSV folder for each combination of ``by``; returns the manifest (by, n)."""
    df.write.mode("overwrite").partitionBy(*by).csv(path, header=True)
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def missing_paths(spark: SparkSession, paths: dict[str, str]) -> list[str]:
    """Names of inputs that are not there, asked of their own file system."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for name, path in paths.items():
        p = jvm.org.apache.hadoop.fs.Path(path)
        if not p.getFileSystem(conf).exists(p):
            out.append(name)
    return out
