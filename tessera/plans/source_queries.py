"""Sources and sinks: files are written from the driver tables to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators.graph import connected_components
from tessera.sources import plates, sequences, tabular
from tessera.storage import shared_path

from .registry import query
from .tables import r6, table

#: Letters of a hexadecimal digest as bases.
HEX, LETTERS = "0123456789abcdef", "ACGTACGTACGTACGT"


def _seq(text):
    return F.translate(F.md5(F.col(text).cast("binary")), HEX, LETTERS)


def _seq_sql(text: str) -> str:
    return f"translate(md5({text}), '{HEX}', '{LETTERS}')"


def _text(df, spark, label: str, *columns) -> str:
    """A folder of text files with one tab-separated line a row."""
    path = shared_path(spark, label)
    df.select(F.concat_ws("\t", *columns).alias("value")).write.text(path)
    return path


def _fastq(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    path = shared_path(spark, "reads")
    reads = p.select(F.col("p_brand").alias("sample_id"), F.col("p_partkey").alias("read_id"), F.lower(_seq("p_name")).alias("seq"), F.repeat(F.chr(33 + F.col("p_size") % 40), F.lit(32)).alias("quality"))
    sequences.write_fastq(reads, path)
    return path


@query("scan_fastq", f"SELECT p_brand || '__' || p_partkey AS read_id, {_seq_sql('p_name')} AS seq, CAST(p_size % 40 AS DOUBLE) AS q FROM part")
def scan_fastq(spark, sf_dir):
    return sequences.read_fastq(spark, _fastq(spark, sf_dir)).select("read_id", "seq", r6("q").alias("q"))


@query("scan_fastq_counts", "SELECT count(*) AS n_reads FROM part")
def scan_fastq_counts(spark, sf_dir):
    return sequences.count_reads(spark, _fastq(spark, sf_dir)).agg(F.sum("n_reads").alias("n_reads"))


def _fasta(spark, sf_dir):
    path = shared_path(spark, "references")
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("P"), F.col("p_partkey") % 97).alias("name"), F.concat(F.lower(_seq("p_name")), F.lit("\n"), _seq("p_brand")).alias("seq"), F.col("p_size").alias("size"))
    sequences.write_fasta(p, path, fields=["size"])
    return sequences.read_fasta(spark, path)


@query("scan_fasta", f"SELECT 'P' || p_partkey % 97 AS id, {_seq_sql('p_name')} || {_seq_sql('p_brand')} AS seq, CAST(p_size AS VARCHAR) AS size FROM part")
def scan_fasta(spark, sf_dir):
    return sequences.header_values(_fasta(spark, sf_dir), ["size"]).select("id", "seq", "size")


@query("multicopy_fasta", f"SELECT 'P' || p_partkey % 97 AS id, count(*) AS n_copies, array_to_string(list_sort(list({_seq_sql('p_name')} || {_seq_sql('p_brand')})), ',') AS copies FROM part GROUP BY 1")
def multicopy_fasta(spark, sf_dir):
    copies = sequences.multicopy_table(_fasta(spark, sf_dir))
    return copies.select("id", F.size("copies").cast("long").alias("n_copies"), F.array_join(F.array_sort("copies"), ",").alias("copies"))


@query("scan_genbank", f"SELECT 'c' || p_partkey AS name, {_seq_sql('p_name')} AS seq FROM part WHERE p_size % 10 <> 0")
def scan_genbank(spark, sf_dir):
    """Every tenth size is a record of N alone, which the scan leaves out."""
    path = shared_path(spark, "contigs")
    seq = F.when(F.col("p_size") % 10 == 0, F.repeat(F.lit("n"), F.lit(32))).otherwise(F.lower(_seq("p_name")))
    blocks = F.concat(F.lit("        1 "), F.substring(seq, 1, 10), F.lit(" "), F.substring(seq, 11, 10), F.lit("\n       21 "), F.substring(seq, 21, 12))
    record = F.concat(F.lit("LOCUS       c"), F.col("p_partkey"), F.lit(" 32 bp\nORIGIN\n"), blocks, F.lit("\n//"))
    table(spark, sf_dir, "part").select(record.alias("value")).write.text(path)
    return sequences.read_genbank(spark, path).select("name", "seq")


@query(
    "scan_paf",
    """WITH h AS (SELECT l_orderkey, l_linenumber, 'S' || l_suppkey AS tname, CAST(l_quantity AS INTEGER) AS nmatch, CAST(l_quantity AS INTEGER) + l_linenumber AS alnlen FROM lineitem)
SELECT 'w' || l_orderkey AS sample_id, tname AS best_hit, nmatch, round(nmatch / alnlen, 6) AS identity FROM h QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY nmatch DESC, nmatch / alnlen DESC, tname DESC) = 1""",
)
def scan_paf(spark, sf_dir):
    x, n = table(spark, sf_dir, "lineitem"), F.col("l_quantity").cast("int")
    path = _text(x, spark, "alignments", F.concat(F.lit("w"), F.col("l_orderkey"), F.lit("__1")), F.lit(90), F.lit(0), F.lit(90), F.lit("+"), F.concat(F.lit("S"), F.col("l_suppkey")), F.lit(99), F.lit(0), F.lit(90), n, n + F.col("l_linenumber"), F.lit(60), F.lit("extra:i:1"))
    best = tabular.best_alignments(tabular.read_paf(spark, path))
    return best.select(F.split("qname", "__")[0].alias("sample_id"), F.col("tname").alias("best_hit"), "nmatch", r6("identity").alias("identity"))


@query("scan_blast", "SELECT 'q' || l_orderkey || '_' || l_linenumber AS qseqid, 'G' || l_suppkey AS genome, CAST(l_linenumber + l_partkey % 5 AS INTEGER) AS diffs FROM lineitem")
def scan_blast(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem")
    path = _text(x, spark, "hits", F.concat_ws("_", F.concat(F.lit("q"), F.col("l_orderkey")), "l_linenumber"), F.concat(F.lit("G"), F.col("l_suppkey"), F.lit("|c"), F.col("l_partkey")), F.lit(99.0), F.lit(100), F.lit(100), F.col("l_linenumber"), F.col("l_partkey") % 5, F.lit(1), F.lit(100), F.lit(180.0))
    return tabular.read_blast(spark, path).select("qseqid", "genome", "diffs")


def _ani(spark, sf_dir):
    n = F.col("s_suppkey")
    ref, other = (F.concat(F.lit("/g/W"), k.cast("string"), F.lit(".fa")) for k in (n, n * 7 % 50 + 1))
    path = shared_path(spark, "ani")
    s = table(spark, sf_dir, "supplier").select(ref.alias("Ref_file"), other.alias("Query_file"), (99 + n % 10 / 10).alias("ANI"), (n % 90).alias("Align_fraction_ref"), (n % 80).alias("Align_fraction_query"))
    s.write.csv(path, sep="\t", header=True)
    return tabular.read_ani(spark, path)


ANI_SQL = """a AS (SELECT 'W' || s_suppkey AS x, 'W' || (s_suppkey * 7 % 50 + 1) AS y, 99 + s_suppkey % 10 / 10 AS ani, s_suppkey % 90 AS fx, s_suppkey % 80 AS fy FROM supplier),
ani AS (SELECT least(x, y) AS well_a, greatest(x, y) AS well_b, ani, CASE WHEN x > y THEN fy ELSE fx END AS af_a, CASE WHEN x > y THEN fx ELSE fy END AS af_b FROM a WHERE x <> y)"""


@query("scan_ani", f"WITH {ANI_SQL} SELECT well_a, well_b, round(ani, 6) AS ani, CAST(af_a AS DOUBLE) AS af_a, CAST(af_b AS DOUBLE) AS af_b FROM ani")
def scan_ani(spark, sf_dir):
    return _ani(spark, sf_dir).select("well_a", "well_b", r6("ani").alias("ani"), "af_a", "af_b")


@query(
    "clone_clusters",
    f"""WITH RECURSIVE {ANI_SQL}, e AS (SELECT well_a AS a, well_b AS b FROM ani WHERE ani >= 99.5 UNION SELECT well_b, well_a FROM ani WHERE ani >= 99.5), reach AS (SELECT a AS v, a AS r FROM e UNION SELECT reach.v, b FROM reach JOIN e ON reach.r = e.a),
c AS (SELECT v, min(r) AS c FROM reach GROUP BY 1), n AS (SELECT c, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, c) AS k FROM c GROUP BY 1) SELECT v AS well, CAST(k AS INTEGER) AS clone_cluster, n FROM c JOIN n USING (c)""",
)
def clone_clusters(spark, sf_dir):
    return tabular.clone_clusters(_ani(spark, sf_dir), limit=99.5)


@query(
    "scan_gff",
    f"""WITH g AS (SELECT 'c' || p_partkey AS seqid, 1 + p_size % 10 AS s, 20 + p_size % 10 AS e, CASE WHEN p_partkey % 2 = 0 THEN '-' ELSE '+' END AS strand, {_seq_sql('p_name')} AS c FROM part WHERE p_size % 3 <> 0), x AS (SELECT *, substr(c, CAST(s AS BIGINT), CAST(e - s + 1 AS BIGINT)) AS part FROM g)
SELECT seqid, CAST(s AS INTEGER) AS start, CAST(e AS INTEGER) AS "end", strand, CASE WHEN strand = '-' THEN reverse(translate(part, 'ACGT', 'TGCA')) ELSE part END AS seq FROM x""",
)
def scan_gff(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    product = F.when(F.col("p_size") % 3 == 0, F.lit("Name=23S_rRNA")).otherwise(F.lit("Name=16S_rRNA"))
    path = _text(p, spark, "genes", F.concat(F.lit("c"), F.col("p_partkey")), F.lit("x"), F.lit("rRNA"), 1 + F.col("p_size") % 10, 20 + F.col("p_size") % 10, F.lit("."), F.when(F.col("p_partkey") % 2 == 0, F.lit("-")).otherwise(F.lit("+")), F.lit("."), product)
    contigs = p.select(F.concat(F.lit("c"), F.col("p_partkey")).alias("seqid"), _seq("p_name").alias("seq"))
    return tabular.read_gff_genes(spark, path, contigs, least=20)


@query("scan_summary", "SELECT CAST(event_id AS VARCHAR) AS read_id, CAST(user_id % 512 AS INTEGER) AS channel, event_type = 'click' AS passed, CAST(event_id % 2000 AS INTEGER) AS length, 'A' AS run FROM events")
def scan_summary(spark, sf_dir):
    e, path = table(spark, sf_dir, "events"), shared_path(spark, "summary")
    wide = e.select(F.col("event_id").alias("read_id"), (F.col("user_id") % 512).alias("channel"), F.lit(1.5).alias("start_time"), F.lit(2).alias("duration"), F.upper((F.col("event_type") == "click").cast("string")).alias("passes_filtering"), (F.col("event_id") % 2000).alias("sequence_length_template"), F.lit(12.5).alias("mean_qscore_template"), F.lit("signal").alias("end_reason"), F.col("props").alias("more"))
    wide.write.csv(path, sep="\t", header=True)
    return tabular.read_sequencing_summary(spark, path, "A").select("read_id", "channel", "passed", "length", "run")


@query(
    "pore_occupancy",
    "WITH x AS (SELECT CAST(hour(ts) AS INTEGER) AS minute, CASE event_type WHEN 'click' THEN 'strand' WHEN 'view' THEN 'pore' WHEN 'purchase' THEN 'adapter' ELSE 'zero' END AS s FROM events) SELECT minute, round(count(*) FILTER (s IN ('strand', 'adapter')) / nullif(count(*) FILTER (s <> 'zero'), 0), 6) AS occupancy FROM x GROUP BY 1",
)
def pore_occupancy(spark, sf_dir):
    kind = F.col("event_type")
    state = F.when(kind == "click", "strand").when(kind == "view", "pore").when(kind == "purchase", "adapter").otherwise("zero")
    x = table(spark, sf_dir, "events").select(state.alias("state"), F.hour("ts").alias("minute"), F.lit(1).alias("samples"))
    return tabular.pore_occupancy(x).withColumn("occupancy", r6("occupancy"))


@query("scan_minibar", f"SELECT 's' || p_partkey AS sample_id, right({_seq_sql('p_name')}, 24) AS fwd_barcode, right({_seq_sql('p_brand')}, 24) AS rev_barcode FROM part")
def scan_minibar(spark, sf_dir):
    path = shared_path(spark, "sheet")
    table(spark, sf_dir, "part").select(F.concat(F.lit("s"), F.col("p_partkey")).alias("SampleID"), _seq("p_name").alias("FwIndex"), _seq("p_brand").alias("RvIndex")).write.csv(path, sep="\t", header=True)
    return tabular.read_minibar_sheet(spark, path)


@query("scan_demux_counts", "SELECT 'o' || l_suppkey AS sample_id, count(*) AS n_reads FROM lineitem GROUP BY 1")
def scan_demux_counts(spark, sf_dir):
    path = shared_path(spark, "demux")
    table(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("o"), F.col("l_suppkey")).alias("sample")).agg(F.count("*").alias("reads")).write.csv(path, sep="\t", header=True)
    return tabular.read_demux_counts(spark, path)


@query("scan_feature_table", "SELECT 'S' || l_suppkey AS strain, 'K' || l_linenumber AS feature, CAST(count(*) FILTER (l_returnflag = 'R') AS DOUBLE) AS cnt FROM lineitem GROUP BY 1, 2 HAVING count(*) FILTER (l_returnflag = 'R') > 0")
def scan_feature_table(spark, sf_dir):
    path = shared_path(spark, "features")
    wide = table(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("S"), F.col("l_suppkey")).alias("strain")).pivot("l_linenumber", list(range(1, 8))).agg(F.count_if(F.col("l_returnflag") == "R"))
    wide.na.fill(0).toDF("strain", *[f"K{k}" for k in range(1, 8)]).write.csv(path, header=True)
    return tabular.read_feature_table(spark, path)


@query("scan_distance_matrix", "SELECT x.n_name AS a, y.n_name AS b, CAST(levenshtein(x.n_name, y.n_name) AS DOUBLE) AS d FROM nation x, nation y WHERE x.n_name <> 'CHINA' AND y.n_name <> 'CHINA'")
def scan_distance_matrix(spark, sf_dir):
    """The square matrix of a dimension of 25 names, read back without one of them."""
    path = shared_path(spark, "matrix")
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("a"))
    names = sorted(r["a"] for r in n.collect())
    n.select("a", *[F.levenshtein("a", F.lit(b)).alias(b) for b in names]).write.csv(path, header=True)
    return tabular.read_distance_matrix(spark, path, [b for b in names if b != "CHINA"])


@query("scan_mapping", "SELECT CAST(s_suppkey AS VARCHAR) AS key, CAST(s_nationkey AS VARCHAR) AS value FROM supplier")
def scan_mapping(spark, sf_dir):
    path = shared_path(spark, "mapping")
    table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("w ell"), F.col("s_nationkey").alias("strain")).write.csv(path, header=True)
    return tabular.read_mapping(spark, path, key="w ell", value="strain")


@query("sink_partitioned", "SELECT o_orderpriority, o_orderstatus, count(*) AS n, count(*) AS n_read FROM orders GROUP BY 1, 2")
def sink_partitioned(spark, sf_dir):
    """The manifest of a sink with one CSV folder for each group, beside what the folders hold."""
    path, by = shared_path(spark, "picklists"), ["o_orderpriority", "o_orderstatus"]
    manifest = tabular.write_partitioned_csv(table(spark, sf_dir, "orders").select(*by, "o_orderkey"), path, by)
    return manifest.join(spark.read.csv(path, header=True).groupBy(*by).agg(F.count("*").alias("n_read")), by)


@query("scan_layout", "SELECT printf('Plate%02d_%s', c_custkey % 16, chr(CAST(65 + c_custkey % 16 AS INTEGER)) || CAST(1 + c_custkey % 24 AS VARCHAR)) AS sample_id, CAST(c_nationkey AS INTEGER) AS fwd_idx, CASE WHEN c_custkey % 5 > 0 THEN CAST(c_custkey % 30 AS INTEGER) END AS separation_bp FROM customer")
def scan_layout(spark, sf_dir):
    """Every fifth separation is written as text that is no number."""
    path, k = shared_path(spark, "layout"), F.col("c_custkey")
    well = F.concat(F.chr(65 + k % 16), (1 + k % 24).cast("string"))
    sep = F.when(k % 5 == 0, F.lit("unknown")).otherwise((k % 30).cast("string"))
    table(spark, sf_dir, "customer").select((k % 16).alias("dest_plate"), well.alias("dest_well"), F.col("c_nationkey").alias("fwd_idx"), sep.alias("separation_bp")).write.csv(path, header=True)
    return sequences.read_layout(spark, path).select("sample_id", "fwd_idx", "separation_bp")


def _plates(spark, sf_dir):
    """Parts as plate-reader files: a file a plate of 96, grids at two wavelengths, dealt by row numbers of the part keys."""
    k = F.col("p_partkey")
    cells = table(spark, sf_dir, "part").select(F.floor(k / 96).alias("plate"), F.floor(k % 96 / 12).alias("row"), (k % 12).alias("col"), "p_size")
    rows = cells.groupBy("plate", "row").agg(F.sort_array(F.collect_list(F.struct("col", "p_size"))).alias("c"), F.count("*").alias("n")).filter("n = 12")
    line = lambda wl: F.array_join(F.transform("c", lambda x: F.format_string("%d.%d", x["p_size"], F.lit(wl))), ",")
    full = rows.groupBy("plate").agg(*[F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row", line(wl).alias("t")))), lambda x: x["t"]), "\n").alias(f"g{wl}") for wl in (450, 600)], F.count("*").alias("r")).filter("r = 8")
    text = F.concat(F.lit("Testname: OD\nDate: 01/02/2026  Time: 10:00:00\nID1: "), F.col("plate"), F.lit("\nWavelength: 450 nm\n"), F.col("g450"), F.lit("\n\nWavelength: 600 nm\n"), F.col("g600"), F.lit("\n"))
    path = shared_path(spark, "reader")
    full.select("plate", text.alias("value")).repartition("plate").write.partitionBy("plate").text(path)
    return plates.read_files(spark, f"{path}/*/*.txt")


PLATE_CELLS = "cells AS (SELECT p_partkey // 96 AS plate, CAST(p_partkey % 96 // 12 AS INTEGER) AS row, CAST(p_partkey % 12 AS INTEGER) AS col, p_size FROM part), whole AS (SELECT * FROM cells WHERE plate IN (SELECT plate FROM cells GROUP BY 1 HAVING count(*) = 96))"


@query("scan_plate_grids", f"WITH {PLATE_CELLS} SELECT CAST(plate AS INTEGER) AS plate, CAST(grid AS INTEGER) AS grid, CAST(wl AS INTEGER) AS wavelength, row, col, round(p_size + wl / 1000, 6) AS value FROM whole, (VALUES (0, 450), (1, 600)) g(grid, wl)")
def scan_plate_grids(spark, sf_dir):
    files = _plates(spark, sf_dir)
    cells = plates.grids(files).join(plates.headers(files).select("path", "plate"), "path")
    return cells.select("plate", "grid", "wavelength", "row", "col", r6("value").alias("value"))


@query("scan_plate_od", f"WITH {PLATE_CELLS} SELECT CAST(plate AS INTEGER) AS plate, chr(65 + row) || CAST(col + 1 AS VARCHAR) AS well, round(p_size + 0.6, 6) AS od FROM whole")
def scan_plate_od(spark, sf_dir):
    files = _plates(spark, sf_dir)
    od = plates.to_long(plates.pick_wavelength(plates.grids(files), 600)).join(plates.headers(files).select("path", "plate"), "path")
    return od.select("plate", "well", r6("od").alias("od"))


@query("well_graph", f"WITH RECURSIVE {ANI_SQL}, e AS (SELECT well_a AS a, well_b AS b FROM ani UNION SELECT well_b, well_a FROM ani), reach AS (SELECT a AS v, a AS r FROM e UNION SELECT reach.v, b FROM reach JOIN e ON reach.r = e.a) SELECT v AS vertex, min(r) AS component FROM reach GROUP BY 1")
def well_graph(spark, sf_dir):
    return connected_components(_ani(spark, sf_dir), "well_a", "well_b")
