"""Sequence files as DataFrames, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.sequence import header_label, read_quality, sample_id


def _pieces(spark: SparkSession, path: str | list[str], separator: str | None = None) -> DataFrame:
    """(path, n, value): the pieces of text files (lines, without a ``separator``), numbered from 0 in file order.

    Files are split among tasks as Spark's text source does, so no row is as large as a
    file: pieces are numbered within their split, and splits by the pieces before them."""
    reader = spark.read if separator is None else spark.read.option("lineSep", separator)
    rows = reader.text(path).select("value", F.input_file_name().alias("path"), F.input_file_block_start().alias("_block"), F.monotonically_increasing_id().alias("_id"))
    splits = rows.groupBy("path", "_block").agg(F.min("_id").alias("_first"), F.count("*").alias("_rows"))
    before = Window.partitionBy("path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).select("path", "_block", "_first", "_before")
    return rows.join(splits, ["path", "_block"]).select("path", (F.col("_id") - F.col("_first") + F.col("_before")).alias("n"), "value")


def read_fastq(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, read_id, header, seq upper-cased, quality, q) of FASTQ files, gzipped or not.

    One record for four lines; an empty file has none, a last incomplete record is
    dropped.  ``q`` is the header's quality tag, else the mean Phred score.  A plain
    file is read by as many tasks as it has splits, a gzipped one by one task, line by line."""
    lines = _pieces(spark, path)
    at = lambda k: F.max(F.when(F.col("n") % 4 == k, F.rtrim("value", F.lit("\r"))))
    records = lines.groupBy("path", F.floor(F.col("n") / 4).alias("ordinal")).agg(at(0).alias("header"), F.upper(at(1)).alias("seq"), at(3).alias("quality"), F.count("*").alias("_lines"))
    rows = records.filter((F.col("_lines") == 4) & F.startswith("header", F.lit("@"))).drop("_lines")
    phred = F.aggregate(F.transform(F.array_remove(F.split("quality", ""), ""), lambda c: F.ascii(c) - 33), F.lit(0), lambda s, x: s + x) / F.length("quality")
    return rows.withColumns({"read_id": F.regexp_extract("header", r"^@(\S+)", 1), "q": F.coalesce(read_quality(F.col("header")), phred)})


def count_reads(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, n_reads) from the number of lines alone."""
    return spark.read.text(path).groupBy(F.input_file_name().alias("path")).agg(F.floor(F.count("*") / 4).alias("n_reads"))


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, ordinal, header, name, seq upper-cased) of FASTA files; sequences may span lines; order and duplicates are kept.

    A row is a record: files are cut where a line begins with ``>``."""
    text = F.regexp_replace(F.regexp_replace("value", "\r\n?", "\n"), "^>", "")
    rows = _pieces(spark, path, "\n>").select("path", F.col("n").alias("ordinal"), text.alias("p")).filter(F.trim("p") != "")
    header = F.regexp_extract("p", r"^([^\n]*)", 1)
    seq = F.upper(F.regexp_replace(F.regexp_replace("p", r"^[^\n]*", ""), r"\s", ""))
    return rows.select("path", "ordinal", header.alias("header"), F.regexp_extract(header, r"^(\S+)", 1).alias("id"), header_label(header).alias("name"), seq.alias("seq"))


def reference_table(records: DataFrame) -> DataFrame:
    """(name, seq): the last record of each normalised name."""
    return records.groupBy("name").agg(F.max_by("seq", F.struct("path", "ordinal")).alias("seq"))


def multicopy_table(records: DataFrame) -> DataFrame:
    """(id, copies): all sequences of a record id, in file order."""
    return records.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("path", "ordinal", "seq"))), lambda x: x["seq"]).alias("copies"))


def header_values(records: DataFrame, keys: list[str]) -> DataFrame:
    """``key=value`` tokens of the header as columns."""
    return records.withColumns({k: F.nullif(F.regexp_extract("header", rf"(?:^|\s){k}=(\S+)", 1), F.lit("")) for k in keys})


def read_genbank(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, name, seq) of GenBank files, a row for each record (up to ``//``); records of N alone are left out."""
    text = F.regexp_replace("value", "\r\n?", "\n")
    records = _pieces(spark, path, "\n//").select("path", text.alias("r")).filter(F.rlike("r", F.lit(r"(?m)^LOCUS")))
    seq = F.upper(F.regexp_replace(F.regexp_extract("r", r"(?s)\nORIGIN[^\n]*\n(.*)$", 1), r"[\s0-9]", ""))
    out = records.select("path", F.regexp_extract("r", r"(?m)^LOCUS\s+(\S+)", 1).alias("name"), seq.alias("seq"))
    return out.filter(F.rlike("seq", F.lit("[^N]")))


def assembly_stats(contigs: DataFrame) -> DataFrame:
    return contigs.groupBy("path").agg(F.count("*").alias("n_contigs"), F.sum(F.length("seq")).alias("bp"))


def write_fasta(df: DataFrame, path: str, *, name: str = "name", seq: str = "seq", fields: list[str] | None = None) -> None:
    """One record for each row, ``key=value`` of ``fields`` after the name."""
    extra = [F.concat(F.lit(f" {c}="), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in fields or []]
    df.select(F.concat(F.lit(">"), F.col(name), *extra, F.lit("\n"), F.col(seq)).alias("value")).write.mode("overwrite").text(path)


def write_fastq(df: DataFrame, path: str) -> None:
    """Reads renamed ``sample__read``."""
    body = F.concat(F.lit("@"), F.col("sample_id"), F.lit("__"), F.col("read_id"), F.lit("\n"), F.col("seq"), F.lit("\n+\n"), F.col("quality"))
    df.select(body.alias("value")).write.mode("overwrite").text(path)


def well_paths(layout: DataFrame, files: DataFrame) -> DataFrame:
    """``layout`` with the path of each well's reads, null without one; plain files before gzipped ones.  ``files``: path."""
    name = F.regexp_extract("path", r"([^/]+)\.fastq(\.gz)?$", 1)
    picked = files.select(name.alias("sample_id"), "path").filter("sample_id <> ''").groupBy("sample_id").agg(F.min_by("path", F.struct(F.endswith("path", F.lit(".gz")), "path")).alias("path"))
    return layout.join(picked, "sample_id", "left")


def cohort(layout: DataFrame, counts: DataFrame, *, min_reads: int, sequenced: str = "primary_sequenced") -> DataFrame:
    """Wells with more than ``min_reads`` reads; layouts with a plate role keep sequenced plates only.  ``counts``: path, n_reads."""
    wells = layout.filter(F.col("plate_role") == sequenced) if "plate_role" in layout.columns else layout
    return wells.join(counts, "path", "left").na.fill(0, ["n_reads"]).filter(F.col("n_reads") > min_reads)


def universe_is_current(universe: DataFrame, wells: DataFrame) -> bool:
    """Whether a cached read universe has exactly the read counts of the cohort."""
    have = universe.groupBy("sample_id").agg(F.count("*").alias("n"))
    both = have.join(wells.select("sample_id", F.col("n_reads").alias("m")), "sample_id", "full")
    return both.filter(~F.col("n").eqNullSafe(F.col("m"))).isEmpty()


def read_layout(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Layout CSV with typed columns and ``sample_id``; columns that an earlier layout lacks are absent."""
    kinds = {"dest_plate": "int", "dest_col": "int", "fwd_idx": "int", "rev_idx": "int", "vol1_nL": "int", "vol2_nL": "int", "total_inoculum_nL": "int", "log2_inoculum_ratio": "double", "separation_bp": "int"}
    raw = spark.read.csv(path, header=True)
    typed = raw.withColumns({c: F.col(c).try_cast(t) for c, t in kinds.items() if c in raw.columns})
    return typed.withColumn("sample_id", sample_id(F.col("dest_plate"), F.col("dest_well")))
