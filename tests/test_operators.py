"""Branches that the driver tables do not reach."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import sequence as S
from tessera.functions.draws import uniform, uniforms
from tessera.operators import folds, genomes, pairs, quality, scoring, stats, wells
from tessera.operators import identity as I
from tessera.operators import plate_controls as P
from tessera.operators import windows as W
from tessera.operators.graph import connected_components


def test_scores_of_empty_denominators(spark):
    reads = spark.createDataFrame([("w1", "off_target"), ("w1", "off_target"), ("w2", "strain1"), ("w2", "ambiguous")], "sample_id string, read_class string")
    got = {r["sample_id"]: r for r in scoring.score_wells(reads, by=["sample_id"]).collect()}
    assert got["w1"]["relative_abundance_strain1"] is None and got["w1"]["off_target_frac"] == 1.0 and got["w1"]["log2_ratio_strain1_over_strain2"] == 0.0
    assert got["w2"]["relative_abundance_strain1"] == 0.75 and got["w2"]["relative_abundance_strain1_confident"] == 1.0


def test_read_calls(spark):
    rows = [(0.1, 0.2, 3, 9), (0.2, 0.1, 9, 3), (0.1, 0.1, 4, 4), (0.5, 0.6, 1, 9)]
    df = spark.createDataFrame(rows, "d1 double, d2 double, b1 int, b2 int")
    calls = df.select(scoring.read_class(F.col("d1"), F.col("d2"), F.col("b1"), F.col("b2"), 0.3)).collect()
    assert [r[0] for r in calls] == ["strain1", "strain2", "ambiguous", "off_target"]


def test_pairs(spark):
    wells_ = spark.createDataFrame([("b", "a", 0.8, 2.0, 5, 0.1, 0.0, 4.0), ("a", "b", 0.2, -2.0, 5, 0.1, 0.0, 4.0), ("c", "d", 0.5, 0.0, 5, 0.5, 0.0, None)], "strain1 string, strain2 string, relative_abundance_strain1 double, log2_ratio_strain1_over_strain2 double, n_reads int, uncertainty_score double, off_target_frac double, bp double")
    stats_ = scoring.replicate_stability(pairs.canonical(wells_), bp_col="bp")
    got = {r["strain_a"]: r for r in stats_.collect()}
    assert got["a"]["mean_relative_abundance_a"] == pytest.approx(0.2) and got["a"]["std_relative_abundance_a"] == pytest.approx(0)
    assert got["a"]["below_resolution_limit"] and got["a"]["high_uncertainty_pair"] and not got["a"]["unstable_replicate"]
    assert got["c"]["std_relative_abundance_a"] is None and got["c"]["range_relative_abundance_a"] is None and got["c"]["high_uncertainty_pair"]
    strains = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("lonely",)], "strain string")
    scores = {r["strain"]: r for r in scoring.competitiveness(stats_, strains).collect()}
    assert scores["lonely"]["n_opponents"] == 0 and scores["lonely"]["competitiveness_score"] is None
    assert scores["a"]["competitiveness_score"] == pytest.approx(-scores["b"]["competitiveness_score"])
    one = pairs.orient_to_strain(stats_, "b").collect()
    assert [(r["opponent"], round(r["share_self"], 6)) for r in one] == [("a", 0.8)]


def test_hierarchy(spark):
    edges = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.8), ("a", "c", 0.1), ("c", "d", 0.5), ("x", "y", 0.7)], "strain_a string, strain_b string, s double")
    won = scoring.win_edges(edges, F.col("s"))
    assert won.count() == 4
    assert scoring.intransitive_triads(won).first().asDict() == {"n_triads": 1, "n_cyclic": 1, "cyclic_frac": 1.0}
    main = scoring.main_component(edges)
    assert {r[0] for r in main.collect()} == {"a", "b", "c", "d"}
    assert scoring.in_component(edges, main).count() == 4
    dci = scoring.directional_consistency(won, scoring.win_ranks(won)).first()
    assert (dci["n_consistent"], dci["n_inconsistent"]) == (3, 1)


def test_components_of_a_long_path_and_a_star(spark):
    n = 200
    edges = [(k, k + 1) for k in range(n)] + [(1000, 1000 + k) for k in range(1, 60)] + [(5, 5), (2000, 2000), (None, 3)]
    got = {r["vertex"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert {got[k] for k in range(n + 1)} == {0} and {got[1000 + k] for k in range(60)} == {1000} and got[2000] == 2000
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_ladders(spark):
    rows = [("mono", 100, 12, None), ("mono", 5, 2, None), ("pair", 100, 50, 10), ("pair", 100, 50, None), ("pair", 10, 1, 2), ("mono", 20, None, None)]
    df = spark.createDataFrame(rows, "t string, n long, n1 long, n2 long")
    got = [r[0] for r in df.select(quality.qc_status(*map(F.col, ("t", "n", "n1", "n2")))).collect()]
    assert got == ["mono_confirmed", "mono_low_confidence", "pair_both_confirmed", "pair_single_dominant", "pair_neither_confirmed", "mono_low_confidence"]
    v = spark.createDataFrame([("x", "x", True, None), ("y", "x", True, True), ("z", "x", True, None), (None, "x", True, None), ("x", "x", False, None)], "b string, e string, k boolean, t boolean")
    assert [r[0] for r in v.select(quality.identity_verdict(*map(F.col, ("b", "e", "k", "t")))).collect()] == ["supported", "ambiguous", "contradicted", "absent", "absent"]
    c = spark.createDataFrame([(2, 2, 0, 2, 1), (1, 1, 2, 3, 1), (1, 2, 0, 1, 1), (1, 1, 0, 1, 1), (0, 0, 4, 4, 2), (0, 0, 2, 2, 1), (0, 0, 1, 1, 1)], "a int, b int, c int, d int, e int")
    assert [r[0] for r in c.select(quality.consensus_status(*map(F.col, "abcde"))).collect()] == ["ok_monos_agree", "ok_mono_plus_pairs", "monos_disagree", "mono_only", "ok_pairs_corroborated", "pairs_only_weak", "single_well"]
    with pytest.raises(Exception, match="one to one"):
        twice = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
        quality.one_to_one(spark.createDataFrame([(1,)], "k int"), twice, ["k"]).collect()


def test_windows(spark):
    df = spark.createDataFrame([("g", 1.0), ("g", 1.0), ("h", 2.0), ("h", 4.0)], "g string, x double")
    assert [r[0] for r in df.select(W.zscore("x", ["g"]).alias("z")).orderBy("z").collect()] == [None, None, -1.0, 1.0]
    p = spark.createDataFrame([(1, 0.01), (1, 0.02), (1, 0.02), (1, 0.9)], "g int, p double")
    assert sorted(round(r["q"], 6) for r in W.with_q_values(p, "p", ["g"]).collect()) == [0.026667, 0.026667, 0.026667, 0.9]
    ranks = spark.createDataFrame([(1.0,), (1.0,), (5.0,)], "x double").withColumn("k", F.lit(1))
    assert sorted(r[0] for r in ranks.select(W.average_rank("x", ["k"])).collect()) == [1.5, 1.5, 3.0]
    swap = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (2, "a", "p"), (2, "b", "q"), (3, "a", "z")], "plate int, well string, s string")
    out = {(r["plate"], r["well"]): r["s"] for r in pairs.ordinal_swap(swap, group="plate", order=["well"], groups=(1, 2), columns=["s"]).collect()}
    assert out == {(1, "a"): "p", (1, "b"): "q", (2, "a"): "x", (2, "b"): "y", (3, "a"): "z"}


def test_valley(spark):
    low, high = [(0.01 + 0.0005 * k,) for k in range(40)], [(0.25 + 0.001 * k,) for k in range(80)]
    df = spark.createDataFrame([*low, *high, (None,), (float("nan"),)], "d double")
    cut = stats.valley_threshold(df, "d", lo=0.04, hi=0.2)
    assert 0.1 < cut < 0.13
    flat = spark.createDataFrame([(0.001 * k,) for k in range(400) for _ in range(3)], "d double")
    assert stats.valley_threshold(flat, "d", lo=0.04, hi=0.2, empty_frac=0.0001, fallback=0.08) == 0.08
    last = stats.histogram(spark.createDataFrame([(0.4,), (0.0,)], "d double"), "d", low=0.0, high=0.4, bins=80)
    assert {r["bin"] for r in last.collect()} == {0, 79}


def test_sequences(spark):
    df = spark.createDataFrame([("ACGTR", "ACGTA", "B07", ">S1_consensus x", "@r|Hh(1),x qs:f:11.5")], "a string, b string, w string, h string, q string")
    row = df.select(
        S.reverse_complement(F.col("a")).alias("rc"), S.mask_mismatches(S.base_masks(F.col("a")), S.base_masks(F.col("b")), 1).alias("m"), S.well_row(F.col("w")).alias("r"), S.well_col(F.col("w")).alias("c"),
        S.header_label(F.col("h")).alias("l"), S.read_quality(F.col("q")).alias("q"), S.match_class(F.col("q")).alias("mc"), S.norm_edit_distance(F.lit(""), F.lit("")).alias("e"),
        S.fill_ambiguity(F.lit("ACGT"), F.array(F.struct(F.lit(1).alias("pos"), F.lit("T").alias("alt")), F.struct(F.lit(2).alias("pos"), F.lit("G").alias("alt")))).alias("f"),
    ).first()
    assert (row["rc"], row["m"], row["r"], row["c"], row["l"], row["q"], row["mc"], row["e"], row["f"]) == ("YACGT", 0, 1, 7, "S1", 11.5, "Hh", None, "AYGT")


def test_folds_agree_when_organisms_are_strains(spark):
    names = [f"s{k:02d}" for k in range(20)]
    p = spark.createDataFrame([(a, b) for i, a in enumerate(names) for b in names[i + 1 :]], "strain_a string, strain_b string")
    roles = folds.strain_folds(p, folds.unit_folds(spark.createDataFrame([(n,) for n in names], "strain string"), "strain", 4))
    assert roles.filter("role = 'test'").groupBy("fold").count().collect()
    same = spark.createDataFrame([(n, n) for n in names], "strain string, organism string")
    assert folds.purge(roles, same).count() == roles.count()
    assert folds.exposure(roles, same).filter("exposed > 0").count() == 0
    clones = spark.createDataFrame([(n, "o" if k < 10 else n) for k, n in enumerate(names)], "strain string, organism string")
    assert folds.purge(roles, clones).count() < roles.count()


def test_genomes(spark):
    stock = spark.createDataFrame([("A1", 5, "x"), ("A2", None, "old M77 b"), ("A3", 6, "y"), ("A4", None, "z")], "well string, strain_number int, label string")
    sheet = spark.createDataFrame([(5, "ALT9"), (6, None)], "strain_number int, alternative_name string")
    got = {r["well"]: (r["isolate"], r["source"]) for r in genomes.resolve_isolates(stock, sheet).collect()}
    assert got == {"A1": ("ALT9", "alternative"), "A2": ("M77", "label"), "A3": ("6", "number"), "A4": (None, None)}
    w = spark.createDataFrame([("a", "u1", None), ("b", "u1", None), ("c", "u2", "u1"), ("d", None, None)], "well string, genome_unit string, is_of string")
    groups = {r["well"]: r["cv_group"] for r in genomes.cv_groups(w).collect()}
    assert groups["a"] == groups["b"] == groups["c"] != groups["d"]


def test_wells_of_reads(spark):
    reads = spark.createDataFrame([("w", f"r{k:02d}", ("ACGT" * 30 if k < 12 else "TTGCA" * 24), float(k)) for k in range(20)], "sample_id string, read_id string, seq string, q double")
    row = wells.cluster_wells(reads, 0.2).first()
    assert (row["n_reads"], row["n_strains"], row["cluster_sizes"], row["top_frac"]) == (20, 2, [12, 8], 0.6)
    assert {r["consensus"] for r in wells.populations(reads).collect()} == {"ACGT" * 30, "TTGCA" * 24}
    assert wells.capped_reads(reads, cap=5, low=1).count() == 5
    assert wells.read_distances(reads).count() == 190
    seeds = spark.createDataFrame([("w", "s1", "ACGT" * 30)], "sample_id string, strain string, seq string")
    assert wells.seeded_groups(reads, seeds).filter("strain = 's1'").count() == 1
    summary = wells.composition_summary(wells.cluster_wells(reads, 0.2).withColumn("well_type", F.lit("pair"))).first()
    assert summary["share_2"] == 1.0
    hap = wells.haplotypes(reads.withColumn("strain", F.lit("s")).limit(12), spark.createDataFrame([("s", "ACGT" * 30)], "strain string, consensus string"))
    assert hap.count() == 1


def test_plate_controls(spark):
    cells = spark.createDataFrame([(0, r, c, f"s{r}{c}") for r in range(16) for c in range(24)], "plate int, row int, col int, label string")
    moved = cells.withColumn("row", F.lit(15) - F.col("row")).withColumn("col", F.lit(23) - F.col("col"))
    top = P.transform_search(moved.drop("plate"), cells.drop("plate"), P.candidate_transforms(spark), replicates=20).orderBy(F.desc("share")).first()
    assert top["transform"] == "half_turn" and top["share"] == 1.0 and top["family_p"] < 0.06
    near = spark.createDataFrame([(0, 1, 1, "a"), (0, 8, 8, "b")], "plate int, row int, col int, label string")
    home = spark.createDataFrame([(0, 1, 2, "a"), (0, 9, 8, "b")], near.schema)
    found = P.locality(near, home, cells, draws=60).first()
    assert found["observed"] == 1.0 and found["p_value"] < 0.1
    d = spark.createDataFrame([(a, b, 0 if a == b else 9) for a in "xyz" for b in "xyz"], "a string, b string, d int")
    combos = spark.createDataFrame([("s1", "x", "y"), ("s2", "x", "y"), ("s3", "z", "y")], "sample string, fwd string, rev string")
    assert {r["sample"]: r["n"] for r in P.confusable(d, combos, 3).collect()} == {"s1": 1, "s2": 1, "s3": 0}


def test_bounded_distances_against_all_couples(spark):
    """Segments find every couple within the limit, short and repeated texts included."""
    import random

    from tessera.functions.alignment import distance
    from tessera.operators import identity

    draw = random.Random(3)
    base = ["".join(draw.choices("AC", k=n)) for n in (0, 1, 2, 3, 5, 8, 12, 20, 20)]
    texts = base + ["".join(c for c in t if draw.random() > 0.1) + "C" * draw.randrange(3) for t in base for _ in range(6)]
    rows = [(f"t{k}", t) for k, t in enumerate(texts)] + [("none", None)]
    df = spark.createDataFrame(rows, "name string, seq string")
    for limit in (0, 1, 3):
        got = {(r["query"], r["ref"]): r["bp"] for r in identity.distances(df, df, limit=limit).collect()}
        want = {(a, b): distance(x, y) for a, x in rows[:-1] for b, y in rows[:-1] if distance(x, y) <= limit}
        assert got == want


def test_intermediate_tables_are_cleaned_up(spark):
    import os

    from tessera import storage

    path = storage.materialize(spark.range(3), "some").inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.exists(path)
    storage.clean(spark)
    assert not os.path.exists(path)


def test_win_edges_do_not_depend_on_the_order_of_a_sum(spark):
    """A mean of a half is a tie even if its last bit was lost on the way."""
    rows = [(1, 2, 0.5 - 2**-54), (1, 3, 0.5 + 2**-53), (1, 4, 0.5), (5, 6, 0.5 + 1e-9), (5, 7, 0.5 - 1e-9), (5, 8, None)]
    edges = scoring.win_edges(spark.createDataFrame(rows, "strain_a int, strain_b int, m double"), F.col("m"))
    assert sorted(map(tuple, edges.collect())) == [(5, 6, True), (5, 7, False)]


def test_triads_without_a_tied_edge(spark):
    rows = [(1, 2, 0.9), (2, 3, 0.8), (1, 3, 0.5 - 2**-54), (1, 4, 0.1), (2, 4, 0.9)]
    edges = scoring.win_edges(spark.createDataFrame(rows, "strain_a int, strain_b int, m double"), F.col("m"))
    assert scoring.intransitive_triads(edges).first()[:2] == (1, 1)  # 1 beats 2, 2 beats 4, 4 beats 1; 1 and 3 are tied


def test_draws_of_arrays_are_those_of_expressions(spark):
    """Resampling without a row for each draw: the same draws, for short keys and for those of more than one block."""
    keys = ["a", "", "7|9", "x" * 49, "x" * 50, "y" * 80]
    df = spark.createDataFrame([(k,) for k in keys], "k string").withColumn("r", F.explode(F.sequence(F.lit(9), F.lit(101))))
    want = {(r["k"], r["r"]): r["u"] for r in df.withColumn("u", uniform(3, "r", "k")).collect()}
    got = uniforms(3, 9, 101, keys)
    assert all(got[r - 9, i] == want[k, r] for i, k in enumerate(keys) for r in range(9, 102))


def test_coin_shares_and_bootstrap_means(spark):
    edges = spark.createDataFrame([(a, b) for a in range(12) for b in range(a + 1, 12)] + [(None, 4)], "strain_a long, strain_b long")
    want = {r[0]: r[1] for r in stats.coin_flips(edges, 30).groupBy("replicate").agg(F.avg(F.col("a_wins").cast("double"))).collect()}
    assert {r["replicate"]: r["share"] for r in stats.coin_shares(edges, 30).collect()} == pytest.approx(want)
    assert "Generate" not in stats.coin_shares(edges, 30)._jdf.queryExecution().toString()
    rows = [(g, u, float(u * g % 7) if u % 5 else None) for g in range(5) for u in range(g, 40)] + [(9, 1, None), (0, 3, 2.0)]
    wells_ = spark.createDataFrame(rows, "g long, u long, x double")
    mean = (F.sum(F.col("x") * F.col("weight")) / F.sum("weight")).alias("m")
    want = {tuple(r[:2]): r[2] for r in stats.bootstrap(wells_, unit="u", replicates=25).groupBy("g", "replicate").agg(mean).collect()}
    means = stats.bootstrap_means(wells_, unit="u", value="x", by="g", replicates=25)
    got = {tuple(r[:2]): r[2] for r in means.collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)
    assert "Generate" not in means._jdf.queryExecution().toString()


def test_agreement_compares_distinct_sequences(spark):
    names = [f"{k:03d}" for k in range(30)]
    rows = [("s", k % 2, names[k % 30]) for k in range(6000)] + [("t", k % 3, f"ab{k % 3}" + "c" * (k % 2)) for k in range(300)] + [("e", 0, ""), ("e", 1, ""), ("e", 2, None)]
    got = {tuple(r)[:3]: r["identity"] for r in I.agreement(spark.createDataFrame(rows, "strain string, source int, seq string")).collect()}
    assert got["t", 0, 1] == 0.75 and got["s", 0, 1] == pytest.approx(2 / 3) and got["e", 0, 1] is None
    assert set(got) == {("s", 0, 1), *((s, a, b) for s in "te" for a, b in ((0, 1), (0, 2), (1, 2)))}
    shared = spark.createDataFrame([("s", k % 2, "x" * (k // 2 + 1)) for k in range(20)], "strain string, source int, seq string")
    assert I.agreement(shared).first()["identity"] == 1.0


def test_numbers_of_a_sorted_table(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k"))
    rows = sorted(map(tuple, stats.numbered(df, ["k"], "n").collect()))
    assert [n for _, n in rows] == list(range(5000))


def test_plate_controls_do_not_join_replicates(spark):
    """Labels of all replicates of a plate are counted in one task; no table of wells times replicates is joined by name or sent to all."""
    cells = spark.range(384 * 3).select((F.col("id") / 384).cast("int").alias("plate"), (F.col("id") % 384 / 24).cast("int").alias("row"), (F.col("id") % 24).cast("int").alias("col"), (F.col("id") * F.col("id") % 7).cast("string").alias("label"))
    for out in (P.transform_search(cells, cells, P.candidate_transforms(spark), replicates=4, by=["plate"]), P.adjacency_enrichment(cells, "label", replicates=4)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        out.collect()
        assert "BroadcastHashJoin" not in plan.replace("[_part", "") or "replicate" not in plan.split("BroadcastExchange")[1].split("\n")[0]
        assert "Window [row_number" not in plan
