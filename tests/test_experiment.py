import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import accounting, models, plate_features
from tessera.plans import experiment
from tessera.sources import sequences


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    """Three plates of wells over six references, reads with planted edits; written as files and read back."""
    root = tmp_path_factory.mktemp("run")
    rng = np.random.default_rng(0)
    base = "".join(rng.choice(list("ACGT"), 100))
    refs = {}
    for k in range(6):
        s = list(base)
        for p in rng.choice(100, 12, replace=False):
            s[p] = rng.choice(list("ACGT"))
        refs[f"S{k}"] = "".join(s)
    lines, truth = ["dest_plate,dest_well,plate_role,well_type,strain1,strain2"], {}
    (root / "reads").mkdir()
    for w, (a, b) in enumerate([(0, 1), (0, 1), (1, 2), (0, 2), (2, 3), (3, 3), (4, 5), (0, 5)]):
        well = f"{'ABCDEFGH'[w]}{w + 1}"
        lines.append(f"{w % 3 + 1},{well},primary_sequenced,{'mono' if a == b else 'pair'},S{a},{'S9' if w == 7 else f'S{b}'}")
        share = 0.5 + 0.08 * (b - a)
        out = []
        for r in range(30):
            s = list(refs[f"S{a}" if rng.random() < share else f"S{b}"])
            s[rng.integers(100)] = "A"
            out.append(f"@r{r}\n{''.join(s)}\n+\n{'I' * 100}\n")
        (root / "reads" / f"Plate{w % 3 + 1:02d}_{well}.fastq").write_text("".join(out))
        truth[f"Plate{w % 3 + 1:02d}_{well}"] = share
    (root / "layout.csv").write_text("\n".join(lines) + "\n")
    (root / "ref.fa").write_text("".join(f">{n}_consensus x\n{s}\n" for n, s in refs.items()))
    cohort, reads = experiment.read_run(spark, str(root / "layout.csv"), str(root / "reads"))
    return cohort.cache(), reads.cache(), sequences.reference_table(sequences.read_fasta(spark, str(root / "ref.fa"))).cache(), truth


def test_scores_and_hierarchy(run):
    cohort, reads, refs, truth = run
    assert cohort.count() == 8 and reads.count() == 240
    scored, calls = experiment.interaction_scores(cohort, reads, refs, threshold=0.1)
    got = {r["sample_id"]: r for r in scored.collect()}
    assert len(got) == 7 and sum(r["missing_reference"] for r in got.values()) == 1
    for k, r in got.items():
        if not r["missing_reference"]:
            assert r["n_reads"] == 30 and abs(r["relative_abundance_strain1"] - truth[k]) < 0.3
    assert calls.groupBy("read_class").count().count() >= 2
    tables = experiment.hierarchy(scored)
    assert {r["strain_a"] + r["strain_b"] for r in tables["pairs"].collect()} == {"S0S1", "S1S2", "S0S2", "S2S3", "S4S5"}
    assert {r["strain"] for r in tables["strengths"].collect()} == {"S0", "S1", "S2", "S3"}
    assert tables["triads"].first()["n_triads"] == 1
    assert tables["consistency"].first()["n_consistent"] + tables["consistency"].first()["n_inconsistent"] == 4
    learned, _ = experiment.interaction_scores(cohort, reads, refs)
    assert learned.count() == 7


def test_identity_chain(run, spark):
    cohort, reads, refs, _ = run
    clustered = experiment.wells.cluster_wells(reads.withColumn("read_id", F.col("read_id")), 0.06).join(cohort, "sample_id")
    consensus = experiment.consensus_of(clustered)
    verdicts = {r["query"]: r["verdict"] for r in experiment.identity_of(consensus, refs).collect()}
    assert verdicts["S3"] == "supported" and verdicts["S9"] == "absent"
    cover = experiment.reference_coverage(cohort, {"own": refs}).filter("len IS NULL").collect()
    assert [r["strain"] for r in cover] == ["S9"]
    other = refs.withColumn("seq", F.when(F.col("name") == "S1", F.reverse("seq")).otherwise(F.col("seq")))
    assert {r["strain"] for r in experiment.cross_check(refs, {"other": other}).filter("NOT reliable").collect()} == {"S1"}


def test_flags(run, spark):
    cohort, reads, refs, _ = run
    universe = reads.select("sample_id", "read_id")
    hit = F.when(F.col("sample_id").endswith("A1"), "S4").otherwise("S0")
    paf = universe.select(F.concat("sample_id", F.lit("__"), "read_id").alias("qname"), hit.alias("tname"), F.lit(90).alias("nmatch"), F.lit(100).alias("alnlen"), F.lit(0.9).alias("identity"), F.lit(60).alias("mapq"))
    hits = experiment.contamination(universe, cohort, {"own": paf})
    conf = cohort.select("sample_id", F.lit(20).cast("long").alias("n_conf_strain1"), F.lit(0).cast("long").alias("n_conf_strain2"))
    out = {r["sample_id"]: r for r in experiment.combine_and_flag(cohort.select("sample_id", "well_type", "strain1", "strain2", F.col("n_reads").cast("long").alias("n_reads")), conf, hits.drop("n_reads", "db"), refs).collect()}
    a1 = out["Plate01_A1"]
    assert a1["qc_contaminated"] and a1["top_other"] == "S4" and not a1["likely_twin"] and a1["qc_status"] == "pair_single_dominant"
    assert out["Plate03_F6"]["qc_status"] == "mono_confirmed"


def test_accounting(spark):
    wells = spark.createDataFrame([(1, 100), (1, 300), (9, 2), (9, 4)], "plate int, n_reads int")
    row = accounting.demux_accounting(wells, raw=1000, filtered=500, sequenced=F.col("plate") < 9).first()
    assert (row["reads_on_sequenced"], row["est_false_reads"], row["pct_of_filtered"]) == (400, 6.0, pytest.approx(81.2)) and row["est_false_rate_pct"] == 1.5
    reads = spark.createDataFrame([(100, 100, 200, 0.05, 0.03), (100, 100, 100, 0.02, 0.08), (100, 100, 100, 0.05, 0.05)], "read_len int, len1 int, len2 int, dist1 double, dist2 double")
    got = {r["bin"]: (r["n_reads"], r["n_flipped"]) for r in accounting.flips_by_separation(reads).collect()}
    assert got == {0: (1, 0), 1: (1, 1), 4: (1, 0)}
    grown = spark.createDataFrame([("a", True), ("a", True), ("b", False), ("b", False), ("c", True), ("c", False)], "strain string, grew boolean")
    both = accounting.failures_in_both(grown).first()
    assert (both["both_failed"], both["one_failed"], both["none_failed"]) == (1, 1, 1) and both["enrichment"] == pytest.approx(1 / 0.75)
    dose = spark.createDataFrame([("x", 1, 1.0), ("x", 4, 8.0), ("y", 1, 2.0)], "u string, d int, v double")
    assert [tuple(r) for r in accounting.dose_response(dose, unit="u", dose="d", value="v").collect()] == [("x", 2, 1.0, 8.0, 3.0)]
    label = spark.createDataFrame([("s1", ["s1"], 2, None), ("s1", ["s1", "s2"], 0, "g1"), ("s1", ["s1"], 40, None)], "n string, t array<string>, b int, g string")
    assert [r[0] for r in label.select(accounting.organism_label(*map(F.col, "ntbg"))).collect()] == ["s1", "g1", "unk"]
    many = spark.range(1000).withColumnRenamed("id", "read_id")
    small, large = accounting.downsampled(many, 0.2), accounting.downsampled(many, 0.5)
    assert small.join(large, "read_id", "left_anti").count() == 0 and 150 < small.count() < 250


def test_plate_features(spark):
    cells = spark.createDataFrame([(1, r, c, 0.1 if r == 0 else 0.1 + 0.05 * (r * 3 + c)) for r in range(4) for c in range(4)], "plate int, row int, col int, od double")
    layout = spark.createDataFrame([(1, r, c, f"s{r}{c}") for r in range(1, 4) for c in range(4)], "plate int, row int, col int, strain string")
    wells = plate_features.well_densities(cells, layout)
    assert wells.count() == 12 and wells.agg(F.max(F.abs("od_flat"))).first()[0] < 1e-9  # additive rows and columns leave nothing
    a, b = [1.0, 2.0, 4.0], [3.0, 1.0, 0.5]
    monos = spark.createDataFrame([("a", 1.0, a), ("b", 0.0, b)], "strain string, mono_od_z double, shape array<double>")
    mix = [2 * x + 0.5 * y for x, y in zip(a, b, strict=True)]
    pairs = spark.createDataFrame([("a", "b", 1.0, mix), ("a", "zz", 0.0, a)], "strain_a string, strain_b string, od_z double, shape array<double>")
    rows = plate_features.pair_features(pairs, monos).collect()
    assert len(rows) == 1 and rows[0]["unmix_log2"] == pytest.approx(2.0) and rows[0]["unmix_resid"] == pytest.approx(0, abs=1e-9) and rows[0]["yield_dev"] == 0.5
    turned = plate_features.pair_features(pairs.select(F.col("strain_b").alias("strain_a"), F.col("strain_a").alias("strain_b"), "od_z", "shape"), monos).first()
    assert turned["unmix_log2"] == pytest.approx(-2.0) and turned["spec_closer_a"] == pytest.approx(-rows[0]["spec_closer_a"])
    long_ = spark.createDataFrame([("s", "w", 0.5, w, 1.0 + w / 1000) for w in (450, 600, 850)], "strain string, sample_id string, od_z double, wavelength int, value double")
    spec = plate_features.spectra(long_, ["strain", "sample_id", "od_z"])
    feat = plate_features.mono_features(spec).first()
    assert feat["mono_pigment"] == pytest.approx(1.45 / 1.6) and feat["mono_nir_slope"] == pytest.approx(1.85 / 1.6)


def test_model_controls(spark):
    rng = np.random.default_rng(0)
    strains = [f"s{k:02d}" for k in range(30)]
    x = pd.DataFrame((rng.random((30, 8)) < 0.5).astype(float), index=strains)
    s = x.to_numpy() @ rng.normal(size=8)
    rows = [(strains[i], strains[j], float(s[i] - s[j])) for i in range(30) for j in range(i + 1, 30)]
    pairs = spark.createDataFrame(rows, "strain_a string, strain_b string, y double")
    sources = {"genome": x, "permuted": models.permuted_rows(x, 1)}
    out = models.leave_strains_out(pairs, x, target="y", sources=sources, n_splits=5, repeats=2, alpha=2.0).toPandas()
    r = {k: np.corrcoef(g["observed"], g["predicted"])[0, 1] for k, g in out.groupby("source")}
    assert r["genome"] > 0.6 > r["permuted"]
    v = models.against_permutations(0.8, [0.1, 0.2, 0.0])
    assert v["beats_all"] and v["z"] > 5
    a, b = rng.integers(0, 10, 60), rng.integers(0, 10, 60)
    left = models.matched_removal(a, b, np.arange(60), np.arange(10) < 5, 20, rng)
    assert len(left) <= 40 and set(np.concatenate((a[left], b[left]))) >= set(range(5, 10)) & set(np.concatenate((a, b)))
    prevalence = rng.random(200)
    sets = models.matched_feature_sets(prevalence, np.arange(20), 3, rng)
    assert all(len(q) == 20 and abs(prevalence[q].mean() - prevalence[:20].mean()) < 0.1 for q in sets)
    curve = models.learning_curve(pairs, sizes=[5, 10, 30], repeats=2)
    assert {(q["size"], q["rep"]): q["count"] for q in curve.groupBy("size", "rep").count().collect()} == {(n, k): n * (n - 1) // 2 for n in (5, 10, 30) for k in (0, 1)}
    strength = spark.createDataFrame([("s00", 1.0), ("s01", 0.0)], "strain string, bt_strength double")
    moved = models.transfer(strength, pairs).collect()
    assert len(moved) == 1 and moved[0]["predicted_log2"] == pytest.approx(1 / np.log(2))
