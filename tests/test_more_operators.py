"""Operators that no registered query exercises."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import alignment as A
from tessera.functions import consensus as C
from tessera.functions.pileup import Pileup
from tessera.functions import sequence as S
from tessera.operators import accounting, design, features, folds, identity, models, plate_features, tables, wells
from tessera.operators import plate_controls as P
from tessera.operators.communities import Pool
from tessera.sources import plates, sequences, tabular
from tessera.storage import materialize


def test_sheets_and_sinks(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("SampleID\tFwIndex\tFwPrimer\tRvIndex\tRwPrimer\nx\tAACCGGTTACGT\tp\tTTTTACGTACGT\tq\n")
    row = tabular.read_minibar_sheet(spark, str(tmp_path / "m.tsv"), barcode_bp=8).first()
    assert (row["fwd_barcode"], row["rev_barcode"]) == ("GGTTACGT", "ACGTACGT")
    (tmp_path / "c.tsv").write_text("sample\treads\nx\t12\n")
    assert tabular.read_demux_counts(spark, str(tmp_path / "c.tsv")).first()["n_reads"] == 12
    reads = spark.createDataFrame([("w", "r1", "ACGT", "IIII"), ("w", "r2", "GGGG", "IIII")], "sample_id string, read_id string, seq string, quality string")
    sequences.write_fastq(reads, str(tmp_path / "fq"))
    again = sequences.read_fastq(spark, str(tmp_path / "fq"))
    assert {r["read_id"] for r in again.collect()} == {"w__r1", "w__r2"}
    counts = spark.createDataFrame([("w", 2)], "sample_id string, n_reads long")
    assert sequences.universe_is_current(reads, counts)
    assert not sequences.universe_is_current(reads, counts.withColumn("n_reads", F.lit(3).cast("long")))
    assert design.demux_config("a", "b")["barcode_edit_distance"] == 4


def test_filters_and_labels(spark):
    w = spark.createDataFrame([("pair", 100, 100, False, 20.0, 50), ("pair", 100, 50, False, 20.0, 50), ("mono", 100, 100, False, 20.0, 50), ("pair", 100, 100, True, None, 50)], "well_type string, vol1_nL int, vol2_nL int, missing_reference boolean, ref_pair_bp_dist double, n_reads int")
    assert accounting.standard_wells(w, min_reads=10, min_bp=10).count() == 1
    s = accounting.nested_sets(spark.createDataFrame([("a", 0.95), ("b", 0.5)], "s string, x double"), "x", [0.4, 0.9])
    assert {r["s"]: r["tier"] for r in s.collect()} == {"a": 2, "b": 1}
    n = spark.createDataFrame([("GCF_000123.4_ASM", " ", "y"), ("other", "x", None)], "a string, s1 string, s2 string")
    assert [tuple(r) for r in n.select(S.assembly_accession(F.col("a")), accounting.mono_strain(F.col("s1"), F.col("s2"))).collect()] == [("GCF_000123.4", "y"), ("other", "x")]
    q = plates.assemble_384(spark.createDataFrame([(3, 5, 1.0)], "row int, col int, od double"), F.lit(1), F.lit(0)).first()
    assert (q["row"], q["col"]) == (7, 10)
    many = spark.createDataFrame([(g, k) for g in "ab" for k in range(20)], "g string, k int")
    picked = accounting.stratified_sample(many, "g", 5, key="k")
    assert picked.groupBy("g").count().filter("count <> 5").count() == 0
    assert picked.join(accounting.stratified_sample(many.repartition(3), "g", 5, key="k"), ["g", "k"]).count() == 10


def test_reports(spark):
    best = spark.createDataFrame([("s", "q1", "x"), ("s", "q2", "x"), ("s", "q3", "y")], "src string, query string, best string")
    assert accounting.resolution_report(best, "src").first().asDict() == {"src": "s", "n": 3, "distinct_targets": 2, "collisions": 2, "max_claims": 2}
    v = spark.createDataFrame([("A1", "B2", "contradicted"), ("C3", "D4", "contradicted"), ("A1", "A5", "contradicted"), ("A1", "A1", "supported"), ("x", "A1", "contradicted")], "expected string, best_hit string, verdict string")
    assert [tuple(r)[:3] for r in identity.well_offsets(v).collect()] == [(1, 1, 2), (0, 4, 1)]
    races = spark.createDataFrame([(5.0, 100, 90, 5, 5), (7.0, 100, 99, 0, 1), (50.0, 10, 10, 0, 0)], "bp double, n long, correct long, tied long, wrong long")
    got = {r["bin"]: r for r in accounting.resolution_by_bin(races, [0, 10, 100]).collect()}
    assert got[0]["correct"] == pytest.approx(0.945) and got[0]["median_error"] == pytest.approx(0.03) and got[1]["n_couples"] == 1
    lengths = spark.createDataFrame([("A", 100, "x"), ("A", 1400, "x"), ("A", 1500, "y")], "run string, len int, why string")
    assert {(r["length_class"], r["why"]): r["pct"] for r in accounting.length_classes(lengths, run="run", length="len", reason="why", edges=[0, 1300, 1600]).collect()} == {(0, "x"): 100.0, (1, "x"): 50.0, (1, "y"): 50.0}
    od = spark.createDataFrame([(0.5, True), (0.01, True), (0.9, False)], "od double, drop boolean")
    blank = spark.createDataFrame([(0.05,), (0.06,)], "od double")
    assert {(r["dropout"], r["grew"]): r["n"] for r in accounting.growth_against_dropout(od, blank, dropout=F.col("drop")).collect()} == {(True, True): 1, (True, False): 1, (False, True): 1}
    shares = spark.createDataFrame([("a", 10, 20), ("b", 30, 20), ("c", 0, 0)], "w string, x int, y int")
    got = {r["w"]: r["s"] for r in shares.select("w", accounting.share_change(shares, "x", "y").alias("s")).collect()}
    assert got["a"] == pytest.approx(1.0) and got["c"] is None
    dims = tables.share_dispersion(spark.createDataFrame([("u", "r", 10), ("u", "s", 10), ("v", "r", 20), ("v", "s", 20)], "u string, r string, n long"), unit="u", run="r", n="n").first()
    assert dims["chi2"] == pytest.approx(0) and dims["df"] == 1


def test_reads(spark):
    reads = spark.createDataFrame([("w", f"r{k}", "ACGT", float(k % 5)) for k in range(10)], "sample_id string, read_id string, seq string, q double")
    assert {r["read_id"] for r in wells.top_quality(reads, 2).collect()} == {"r4", "r9"}
    rng = np.random.default_rng(0)
    s = "".join(rng.choice(list("ACGT"), 40))
    df = spark.createDataFrame([(s, s), (A.revcomp(s), s)], "a string, b string")
    assert [r[0] for r in df.select(S.oriented(F.col("a"), F.col("b"))).collect()] == [s, s]
    assert A.block_trimmed_distance(s, "GG" + s[:20] + ("A" if s[20] != "A" else "C") + s[21:]) == 1
    assert C.agree(s, s[:10] + s[11:]) and not C.agree(s, s[::-1])
    assert C.cluster_observations([s, s[::-1], s[1:]]) == [[0, 2], [1]]
    counts, other = (Pileup.of("ACGT", reads).counts for reads in (["ACGT"] * 10 + ["ACTT"] * 10, ["ACGT"] * 20))
    assert C.operon_difference(counts, other, counts.sum(axis=1), other.sum(axis=1)) == pytest.approx(0.5)


def test_bands_and_join(spark):
    shapes = spark.createDataFrame([(f"s{k}", [float(k), 1.0, float(k * k % 7)]) for k in range(8)], "strain string, shape array<double>")
    pairs = spark.createDataFrame([(f"s{i}", f"s{j}", float(i - j)) for i in range(8) for j in range(i + 1, 8)], "strain_a string, strain_b string, y double")
    got = {r["channel"]: r["r"] for r in plate_features.band_profile(pairs, shapes, "y").collect()}
    assert got[0] == pytest.approx(1.0) and got[1] is None
    assert spark.createDataFrame([(1.0, 2.0), (2.0, 4.0)], "x double, y double").agg(plate_features.slope_through_origin(F.col("x"), F.col("y"))).first()[0] == 2.0
    rng = np.random.default_rng(0)
    x = rng.random((14, 3))
    rows = [(f"s{i:02d}", f"s{j:02d}", f"g{i:02d}", f"g{j:02d}", float(np.abs(x[i] - x[j]).sum())) for i in range(14) for j in range(i + 1, 14)]
    d = spark.createDataFrame([(a, b, v) for a, b, _, _, v in rows], "a string, b string, d double")
    jac = spark.createDataFrame([(a, b, -v) for _, _, a, b, v in rows], "a string, b string, jaccard double")
    mapping = spark.createDataFrame([(f"s{i:02d}", f"g{i:02d}") for i in range(14)], "strain string, genome string")
    out = P.join_test(d, jac, mapping, replicates=30).first()
    assert out["rho"] == pytest.approx(-1.0) and out["z"] > 3 and out["passed"]
    f = spark.createDataFrame([("p", "k1"), ("p", "k2"), ("q", "k2"), ("q", "k3"), ("q", "k4")], "strain string, feature string")
    m = features.pair_metabolism(spark.createDataFrame([("p", "q")], "strain_a string, strain_b string"), f).first()
    assert (m["shared"], m["complementary"], m["advantage"], m["jaccard"]) == (1, 3, -1, 0.25)
    sym = spark.createDataFrame([([1.0, 2.0], [3.0, 1.0])], "a array<double>, b array<double>")
    assert sym.select(features.pair_design(F.col("a"), F.col("b"), symmetric=True)).first()[0] == [4.0, 3.0, 2.0, 1.0]
    zero = spark.createDataFrame([("a", 0), ("a", 0), ("b", 2)], "strain string, cnt int")
    assert [r[0] for r in features.empty_strains(zero).collect()] == ["a"]


def test_designs(spark):
    d = {frozenset((a, b)): 20.0 for a in "abcd" for b in "abcd" if a != b}
    c = Pool.of(list("abcd"), d, np.random.default_rng(0))
    c.keep([{"community_id": "C0007", "members": "a b", "size": 2, "module": "old"}])
    again = c.put([1, 0], "new")
    assert again["community_id"] == "C0007" and again["module"] == "old;new" and c.usage[0] == 1
    bc = spark.createDataFrame([("x", 100, 50, 0.001), ("y", 100, 5, 0.001), ("z", 100, 40, 0.5)], "barcode string, n long, k long, q double")
    assert [r["barcode"] for r in design.failed_barcodes(bc).collect()] == ["x"]
    assert len(design.all_wells()) == 384


@pytest.fixture(scope="module")
def fold():
    rng = np.random.default_rng(0)
    n = 30
    x = (rng.random((n, 10)) < 0.5).astype(float)
    s = x @ rng.normal(size=10)
    a, b = rng.integers(0, n, 400), rng.integers(0, n, 400)
    keep = a != b
    a, b = a[keep], b[keep]
    far = np.abs(s[:, None] - s[None, :])
    units = np.array([f"u{k // 2}" for k in range(n)])
    return models.Fold(a, b, s[a] - s[b], np.arange(300), np.arange(300, len(a)), x, x.sum(axis=1, keepdims=True), np.zeros((len(a), 0)), far, 8, units)


@pytest.mark.parametrize("name", sorted(models.MODELS))
def test_every_model(fold, name):
    y = models.MODELS[name](fold)
    truth = fold.y[fold.test]
    assert y.shape == truth.shape and np.isfinite(y).all()
    if name not in ("zero", "clone_lookup"):
        assert np.corrcoef(y, truth)[0, 1] > 0.5, name


@pytest.mark.parametrize("name", sorted(models.YIELD_MODELS))
def test_every_yield_model(fold, name):
    y = models.YIELD_MODELS[name](fold)
    assert y.shape == fold.test.shape and np.isfinite(y).all()


def test_clones_predict_their_mates(fold):
    f = models.Fold(fold.a, fold.b, fold.y, fold.train, fold.test, fold.features, fold.totals, fold.symmetric, None, 8, np.arange(len(fold.features)).astype(str))
    assert np.allclose(models.MODELS["clone_lookup"](f), models.MODELS["strength_observed"](f))


def test_yield_of_unseen_strains(spark):
    rng = np.random.default_rng(0)
    names = [f"s{k:02d}" for k in range(24)]
    x = pd.DataFrame((rng.random((24, 6)) < 0.5).astype(float), index=names)
    c = x.to_numpy() @ rng.normal(size=6)
    pairs = spark.createDataFrame([(names[i], names[j], float(3 + c[i] + c[j])) for i in range(24) for j in range(i + 1, 24)], "strain_a string, strain_b string, y double")
    out = models.leave_strains_out(pairs, x, target="y", n_splits=4, repeats=1, alpha=1.0, symmetric=True).toPandas()
    assert len(out) == 24 and np.corrcoef(out["observed"], out["predicted"])[0, 1] > 0.6


def test_group_folds_hold_groups_together(spark):
    groups = spark.createDataFrame([(f"s{k:02d}", f"g{k // 3}") for k in range(24)], "strain string, g string")
    dealt = folds.unit_folds(groups.select("g"), "g", 4).join(groups, "g").select("rep", "strain", "fold", "g")
    assert dealt.groupBy("g").agg(F.count_distinct("fold").alias("n")).filter("n > 1").count() == 0
    pairs = spark.createDataFrame([(f"s{i:02d}", f"s{j:02d}") for i in range(24) for j in range(i + 1, 24)], "strain_a string, strain_b string")
    roles = folds.strain_folds(pairs, dealt.drop("g"))
    assert folds.exposure(roles, groups.select("strain", F.col("g").alias("organism"))).filter("exposed > 0").count() == 0


def test_purge_deals_no_pairs_anew(spark):
    """Barred strains are sent to the pairs: purging 5 folds must not shuffle the pairs of each."""
    pairs = spark.createDataFrame([(f"s{i}", f"s{j}") for i in range(30) for j in range(i + 1, 30)], "strain_a string, strain_b string")
    dealt = spark.createDataFrame([(0, f"s{i}", i % 5) for i in range(30)], "rep int, strain string, fold int")
    kinds = {f"s{i}": None if i == 7 else i % 12 for i in range(29)}  # one of unknown organism, one without a row
    roles = materialize(folds.strain_folds(pairs, dealt), "roles")
    kept = folds.purge(roles, spark.createDataFrame(list(kinds.items()), "strain string, organism int"))
    rows = [tuple(r) for r in roles.collect()]
    tested = {(f, kinds.get(s)) for _, f, a, b, role in rows for s in (a, b) if role == "test"} - {(f, None) for f in range(5)}
    want = [r for r in rows if r[4] == "test" or not {(r[1], kinds.get(s)) for s in r[2:4]} & tested]
    assert sorted(map(tuple, kept.collect())) == sorted(want) and 0 < sum(r[4] == "train" for r in want) < sum(r[4] == "train" for r in rows)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize("kind", ["string", "bigint", "bigint, wide"])
def test_shared_features_shuffles_lists(spark, kind):
    """Couples are no rows before they are counted: no shuffle by pair, and none by either member after it."""
    name = str if kind == "string" else lambda i: i * (1 << 31 if "wide" in kind else 1) - 3
    rng = np.random.default_rng(5)
    rows = [(name(int(i)), None if f == 9 else int(f)) for i, f in zip(rng.integers(0, 25, 200), rng.integers(0, 30, 200), strict=True)]
    got = features.shared_features(spark.createDataFrame([*rows, *rows[:20], (None, 3)], f"strain {kind.split(',')[0]}, feature int"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    has = {s: {f for x, f in rows if x == s} for s, _ in rows}
    want = {}
    for a in has:
        for b in has:
            both = len(has[a] & has[b] - {None})
            if a < b and both:
                want[a, b] = (both, len(has[a]) - both, len(has[b]) - both, pytest.approx(both / (len(has[a]) + len(has[b]) - both)))
    assert {(r["a"], r["b"]): tuple(r)[2:] for r in got.collect()} == want and got.count() == len(want)
    assert plan.count("hashpartitioning") == 1 and "SortMergeJoin" not in plan


def test_adjacency_of_all_replicates(spark, monkeypatch):
    """5,000 permutations as in the survey's original; wells held in a task give what wells dealt in ranges give."""
    import inspect

    from tessera.plans.catalog import ORACLE_SQL

    assert inspect.signature(P.adjacency_enrichment).parameters["replicates"].default == 5000 and "range(1, 5001)" in ORACLE_SQL["adjacency_enrichment"]
    rows = [(k // 96, k % 96 // 12, k % 12, None if k % 31 == 0 else f"b{k * k % 5}") for k in range(200)] + [(0, 3, 3, "b1"), (None, 1, 1, "b2")]
    cells = spark.createDataFrame(rows, "plate int, row int, col int, label string")
    held = P.adjacency_enrichment(cells, "label", replicates=60).first()
    monkeypatch.setattr(P, "HELD_WELLS", 0)
    dealt = P.adjacency_enrichment(cells.repartition(3), "label", replicates=60).first()
    assert held == pytest.approx(dealt) and 0 < held["null_sd"] and held["observed"] > 0
    monkeypatch.undo()
    assert tuple(P.adjacency_enrichment(cells.filter("row = 0 AND col = 0"), "label", replicates=5).first()) == (None,) * 5
