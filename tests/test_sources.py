import gzip

import pytest
from pyspark.sql import functions as F

from tessera.sources import plates, sequences, tabular


@pytest.fixture
def folder(tmp_path):
    return tmp_path


def test_fastq(spark, folder):
    (folder / "Plate01_A1.fastq").write_text("@r1 qs:f:12.5 x\nacgt\n+\nIIII\n@r2\nGGTA\n+\n!!5I\n@cut\nAC\n")
    with gzip.open(folder / "Plate01_A2.fastq.gz", "wt") as f:
        f.write("@z1\nTTTT\n+\n@@@@\n")
    (folder / "Plate01_A3.fastq").write_text("")
    reads = sequences.read_fastq(spark, str(folder))
    got = {(r["read_id"], r["seq"], round(r["q"], 3)) for r in reads.collect()}
    assert got == {("r1", "ACGT", 12.5), ("r2", "GGTA", 15.0), ("z1", "TTTT", 31.0)}
    layout = spark.createDataFrame([(1, "A1"), (1, "A2"), (1, "B9")], "dest_plate int, dest_well string").withColumn("sample_id", F.format_string("Plate%02d_%s", "dest_plate", "dest_well"))
    paths = {r["sample_id"]: r["path"] for r in sequences.well_paths(layout, reads.select("path").distinct()).collect()}
    assert paths["Plate01_B9"] is None and paths["Plate01_A2"].endswith(".gz")
    counts = sequences.count_reads(spark, str(folder))
    cohort = sequences.cohort(sequences.well_paths(layout, reads.select("path").distinct()), counts, min_reads=1)
    assert [r["sample_id"] for r in cohort.collect()] == ["Plate01_A1"]


def test_fasta_and_references(spark, folder):
    (folder / "a.fa").write_text(">S1_consensus x=3 status=ok\nACGT\nacgt\n>S2|mono\nGG\n>S1 later\nTT\n")
    records = sequences.read_fasta(spark, str(folder / "a.fa"))
    assert [(r["name"], r["seq"]) for r in records.orderBy("ordinal").collect()] == [("S1", "ACGTACGT"), ("S2", "GG"), ("S1", "TT")]
    assert {r["name"]: r["seq"] for r in sequences.reference_table(records).collect()} == {"S1": "TT", "S2": "GG"}
    assert sequences.header_values(records, ["status"]).filter("status = 'ok'").count() == 1
    sequences.write_fasta(sequences.reference_table(records), str(folder / "out"))
    again = sequences.read_fasta(spark, str(folder / "out"))
    assert {r["name"]: r["seq"] for r in again.collect()} == {"S1": "TT", "S2": "GG"}
    copies = {r["id"]: r["copies"] for r in sequences.multicopy_table(records.withColumn("id", F.col("name"))).collect()}
    assert copies["S1"] == ["ACGTACGT", "TT"]


def test_genbank(spark, folder):
    (folder / "g.gb").write_text("LOCUS       c1 8 bp\nFEATURES x\nORIGIN\n        1 acgtacgt\n//\nLOCUS       c2 4 bp\nORIGIN\n        1 nnnn\n//\n")
    contigs = sequences.read_genbank(spark, str(folder / "g.gb"))
    assert [(r["name"], r["seq"]) for r in contigs.collect()] == [("c1", "ACGTACGT")]
    assert sequences.assembly_stats(contigs).first()["bp"] == 8


def test_alignment_tables(spark, folder):
    (folder / "x.paf").write_text("w__r1\t10\t0\t10\t+\tS1\t12\t0\t10\t9\t10\t60\textra:i:1\nw__r1\t10\t0\t10\t+\tS2\t12\t0\t10\t8\t10\t60\n")
    paf = tabular.read_paf(spark, str(folder / "x.paf"))
    universe = spark.createDataFrame([("w", "r1"), ("w", "r2")], "sample_id string, read_id string")
    wells = spark.createDataFrame([("w", "S1", "S3")], "sample_id string, strain1 string, strain2 string")
    got = {r["read_id"]: (r["best_hit_strain"], r["nmatch"], r["is_expected"]) for r in tabular.best_hit_table(universe, paf, wells).collect()}
    assert got == {"r1": ("S1", 9, True), "r2": (None, 0, False)}
    (folder / "empty.paf").write_text("")
    assert tabular.read_paf(spark, str(folder / "empty.paf")).count() == 0
    (folder / "b.tsv").write_text("q\tG1|c2\t99.0\t100\t100\t1\t2\t1\t100\t180\n")
    assert tabular.read_blast(spark, str(folder / "b.tsv")).select("genome", "diffs").first() == ("G1", 3)
    (folder / "ani.tsv").write_text("Ref_file\tQuery_file\tANI\tAlign_fraction_ref\tAlign_fraction_query\n/x/B2.fa\t/x/A1.fa\t99.95\t80\t90\n/x/C3.fa\t/x/C3.fa\t100\t1\t1\n")
    ani = tabular.read_ani(spark, str(folder / "ani.tsv"))
    assert ani.collect()[0].asDict() == {"well_a": "A1", "well_b": "B2", "ani": 99.95, "af_a": 90.0, "af_b": 80.0}
    assert {r["well"] for r in tabular.clone_clusters(ani).collect()} == {"A1", "B2"}


def test_gff(spark, folder):
    (folder / "g.gff").write_text("##gff\nw|c\tx\trRNA\t2\t5\t.\t-\t.\tName=16S_rRNA\nw|c\tx\trRNA\t1\t4\t.\t+\t.\tName=23S_rRNA\n")
    contigs = spark.createDataFrame([("w|c", "AACGTT")], "seqid string, seq string")
    assert [r["seq"] for r in tabular.read_gff_genes(spark, str(folder / "g.gff"), contigs, least=4).collect()] == ["ACGT"]


def test_sheets(spark, folder):
    (folder / "s.tsv").write_text("read_id\tchannel\tstart_time\tduration\tpasses_filtering\tsequence_length_template\tmean_qscore_template\tend_reason\tmore\nr\t7\t1.5\t2\tTRUE\t1400\t12.5\tsignal\tz\n")
    row = tabular.read_sequencing_summary(spark, str(folder / "s.tsv"), "A").first()
    assert (row["channel"], row["passed"], row["run"]) == (7, True, "A")
    (folder / "m.csv").write_text("n,a,b\na,0,2\nb,2,0\n")
    assert tabular.read_distance_matrix(spark, str(folder / "m.csv"), ["a"]).collect()[0].asDict() == {"a": "a", "b": "a", "d": 0.0}
    (folder / "f.csv").write_text("strain,K1,K2\ns1,0,3\ns2,0,0\n")
    assert [tuple(r) for r in tabular.read_feature_table(spark, str(folder / "f.csv")).collect()] == [("s1", "K2", 3.0)]
    (folder / "map.csv").write_text("w,s\nA1,x\nA1,y\n")
    with pytest.raises(ValueError):
        tabular.read_mapping(spark, str(folder / "map.csv"), key="w", value="s")
    pores = spark.createDataFrame([("strand", 1, 6), ("adapter", 1, 1), ("pore", 1, 3), ("zero", 2, 5)], "state string, minute int, samples int")
    assert {r["minute"]: r["occupancy"] for r in tabular.pore_occupancy(pores).collect()} == {1: 0.7, 2: None}
    (folder / "layout.csv").write_text("dest_plate,dest_well,well_type,strain1,strain2,separation_bp\n3,B7,pair,x,y,-1\n")
    lay = sequences.read_layout(spark, str(folder / "layout.csv")).first()
    assert (lay["sample_id"], lay["separation_bp"]) == ("Plate03_B7", -1)
    assert tabular.missing_paths(spark, {"a": str(folder), "b": str(folder / "nope")}) == ["b"]
    manifest = tabular.write_partitioned_csv(spark.createDataFrame([("p", 1), ("q", 2), ("q", 3)], "plate string, v int"), str(folder / "out"), ["plate"])
    assert {r["plate"]: r["n"] for r in manifest.collect()} == {"p": 1, "q": 2}


def plate_text(id1, scale=1.0):
    head = f"Testname: OD scan\nDate: 01/02/2026  Time: 10:00:00\nID1: {id1}\n"
    for wl in (450, 600):
        head += f"Wavelength: {wl} nm\n" + "".join(",".join(f"{scale * (r * 12 + c) + wl / 1000:.3f}" for c in range(12)) + "\n" for r in range(8)) + "\n"
    return head


def test_plate_reader(spark, folder):
    (folder / "p1.csv").write_text(plate_text(11) + "µ", encoding="latin-1")
    (folder / "p2.csv").write_text(plate_text("blank?"), encoding="latin-1")
    files = plates.read_files(spark, str(folder))
    cells = plates.grids(files)
    assert cells.count() == 2 * 2 * 96
    assert plates.pick_wavelength(cells).select("wavelength").distinct().collect()[0][0] == 600
    od = plates.load_folder(spark, str(folder))
    assert od.count() == 96 and od.filter("well = 'B2'").first()["od"] == pytest.approx(13.6)
    wide = plates.spectrum_table(cells, F.lit(1), [450, 600])
    assert set(wide.columns) == {"plate", "well", "450", "600"}
    meta = plates.run_metadata(cells).collect()
    assert {r["format"] for r in meta} == {96} and {r["n_grids"] for r in meta} == {2}
    (folder / "p3.csv").write_text(plate_text(11), encoding="latin-1")
    with pytest.raises(ValueError):
        plates.load_folder(spark, str(folder))


def test_files_of_many_splits(spark, folder):
    """Records keep their number and their lines wherever a split falls."""
    reads = [(f"r{k}", "ACGT"[k % 4] * (1 + k % 17)) for k in range(3000)]
    (folder / "many.fastq").write_text("".join(f"@{i} x\n{s}\n+\n{'@' * len(s)}\n" for i, s in reads))
    (folder / "many.fa").write_text("".join(f">{i}\n{s}\n{s}\n" for i, s in reads))
    (folder / "many.gb").write_text("".join(f"LOCUS       {i} 1 bp\nORIGIN\n        1 {s}\n//\n" for i, s in reads))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 4096)
    try:
        got = sequences.read_fastq(spark, str(folder / "many.fastq"))
        assert [(r["read_id"], r["seq"]) for r in got.orderBy("ordinal").collect()] == reads
        got = sequences.read_fasta(spark, str(folder / "many.fa"))
        assert got.select(F.spark_partition_id()).distinct().count() > 1
        assert [(r["ordinal"], r["id"], r["seq"]) for r in got.orderBy("ordinal").collect()] == [(k, i, s * 2) for k, (i, s) in enumerate(reads)]
        assert {(r["name"], r["seq"]) for r in sequences.read_genbank(spark, str(folder / "many.gb")).collect()} == set(reads)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
