"""Scores, replicates and the hierarchy, on orders as wells and suppliers as strains."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import pairs, quality, scoring
from tessera.operators.graph import connected_components
from tessera.operators.windows import best

from .registry import query
from .tables import ORDER_WELLS, SUPPLIER_WELLS, order_wells, r6, supplier_wells, table


@query(
    "well_score",
    f"""WITH {ORDER_WELLS}
SELECT sample_id, n_reads, n_strain1, n_strain2, n_ambiguous, n_off_target, n_strain1 + n_strain2 + n_ambiguous AS n_on_target,
  round(n_off_target / n_reads, 6) AS off_target_frac,
  round(n_ambiguous / nullif(n_strain1 + n_strain2 + n_ambiguous, 0), 6) AS uncertainty_score,
  round((n_strain1 + 0.5 * n_ambiguous) / nullif(n_strain1 + n_strain2 + n_ambiguous, 0), 6) AS relative_abundance_strain1,
  round(n_strain1 / nullif(n_strain1 + n_strain2, 0), 6) AS relative_abundance_strain1_confident,
  round(log2((n_strain1 + 0.5) / (n_strain2 + 0.5)), 6) AS log2_ratio_strain1_over_strain2 FROM wells""",
)
def well_score(spark, sf_dir):
    wells = order_wells(spark, sf_dir)
    return wells.select(*[r6(c).alias(c) if t == "double" else F.col(c) for c, t in wells.dtypes])


@query(
    "read_call",
    """SELECT event_id, CASE WHEN least(b1, b2) > 90 THEN 'off_target' WHEN b1 = b2 THEN 'ambiguous' WHEN b1 < b2 THEN 'strain1' ELSE 'strain2' END AS read_class
FROM (SELECT event_id, user_id % 97 AS b1, event_id % 89 AS b2 FROM events)""",
)
def read_call(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id") % 97, (F.col("event_id") % 89)).toDF("event_id", "b1", "b2")
    b1, b2 = F.col("b1"), F.col("b2")
    return e.select("event_id", scoring.read_class(b1 / 100, b2 / 100, b1, b2, 0.9).alias("read_class"))


@query(
    "pair_replicates",
    f"""WITH {SUPPLIER_WELLS}
SELECT strain_a, strain_b, n_replicates, round(mean_n_reads, 6) AS mean_n_reads, round(mra, 6) AS mean_relative_abundance_a, round(sra, 6) AS std_relative_abundance_a,
  round(rra, 6) AS range_relative_abundance_a, round(mlr, 6) AS mean_log2_ratio_a_over_b, round(slr, 6) AS std_log2_ratio_a_over_b, round(munc, 6) AS mean_uncertainty_score,
  munc > 0.3 AS high_uncertainty_pair, coalesce(sra > 0.15, false) AS unstable_replicate FROM spairs""",
)
def pair_replicates(spark, sf_dir):
    stats = scoring.replicate_stability(supplier_wells(spark, sf_dir))
    rounded = ["mean_n_reads", "mean_relative_abundance_a", "std_relative_abundance_a", "range_relative_abundance_a", "mean_log2_ratio_a_over_b", "std_log2_ratio_a_over_b", "mean_uncertainty_score"]
    return stats.select("strain_a", "strain_b", "n_replicates", *[r6(c).alias(c) for c in rounded], "high_uncertainty_pair", "unstable_replicate")


@query(
    "orient_competitiveness",
    f"""WITH {SUPPLIER_WELLS}, seen AS (
  SELECT strain_a AS strain, mlr AS r, mra AS s, n_replicates AS n, munc > 0.3 AS h FROM spairs UNION ALL SELECT strain_b, -mlr, 1 - mra, n_replicates, munc > 0.3 FROM spairs)
SELECT s_suppkey AS strain, count(r) AS n_opponents, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_wells, round(avg(r), 6) AS competitiveness_score, round(stddev_samp(r), 6) AS sd_log2_ratio,
  round(avg(s), 6) AS mean_relative_abundance, round(avg(CASE WHEN s IS NULL THEN NULL WHEN s > 0.5 THEN 1.0 ELSE 0.0 END), 6) AS win_fraction,
  round(avg(CASE WHEN h IS NULL THEN NULL WHEN h THEN 1.0 ELSE 0.0 END), 6) AS frac_high_uncertainty_opponents
FROM supplier LEFT JOIN seen ON s_suppkey = strain GROUP BY 1""",
)
def orient_competitiveness(spark, sf_dir):
    stats = scoring.replicate_stability(supplier_wells(spark, sf_dir))
    out = scoring.competitiveness(stats, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("strain")))
    rounded = ["competitiveness_score", "sd_log2_ratio", "mean_relative_abundance", "win_fraction", "frac_high_uncertainty_opponents"]
    return out.select("strain", "n_opponents", "n_wells", *[r6(c).alias(c) for c in rounded])


@query(
    "orient_one_strain",
    f"WITH {SUPPLIER_WELLS} SELECT CASE WHEN strain_a = 3 THEN strain_b ELSE strain_a END AS opponent, round(CASE WHEN strain_a = 3 THEN mlr ELSE -mlr END, 6) AS ratio_self, round(CASE WHEN strain_a = 3 THEN mra ELSE 1 - mra END, 6) AS share_self FROM spairs WHERE strain_a = 3 OR strain_b = 3",
)
def orient_one_strain(spark, sf_dir):
    view = pairs.both_orientations(scoring.replicate_stability(supplier_wells(spark, sf_dir))).filter("strain = 3")
    return view.select("opponent", r6("ratio_self").alias("ratio_self"), r6("share_self").alias("share_self"))


@query(
    "balanced_wells",
    f"WITH {SUPPLIER_WELLS} SELECT strain_a, strain_b, count(*) AS n_wells, round(avg(lr), 6) AS mean_log2_ratio FROM swells WHERE n1 = n2 GROUP BY 1, 2",
)
def balanced_wells(spark, sf_dir):
    wells = supplier_wells(spark, sf_dir).filter(F.col("n_strain1") == F.col("n_strain2"))
    return wells.groupBy("strain_a", "strain_b").agg(F.count("*").alias("n_wells"), r6(F.avg("log2_ratio_a_over_b")).alias("mean_log2_ratio"))


WINS = f"""{SUPPLIER_WELLS}, edges AS (SELECT strain_a, strain_b, mra > 0.5 AS a_wins FROM spairs WHERE mra <> 0.5),
wins AS (SELECT strain, sum(w) AS wins FROM (SELECT strain_a AS strain, CASE WHEN a_wins THEN 1 ELSE 0 END AS w FROM edges UNION ALL SELECT strain_b, CASE WHEN a_wins THEN 0 ELSE 1 END FROM edges) GROUP BY 1),
ranks AS (SELECT strain, CAST(wins AS BIGINT) AS wins, row_number() OVER (ORDER BY wins DESC, strain) - 1 AS rank FROM wins)"""


def _edges(spark, sf_dir):
    return scoring.win_edges(scoring.replicate_stability(supplier_wells(spark, sf_dir)), F.col("mean_relative_abundance_a"))


@query("win_ranks", f"WITH {WINS} SELECT strain, wins, CAST(rank AS BIGINT) AS rank FROM ranks")
def win_ranks(spark, sf_dir):
    return scoring.win_ranks(_edges(spark, sf_dir)).select("strain", "wins", F.col("rank").cast("long").alias("rank"))


@query(
    "dci",
    f"""WITH {WINS}, s AS (SELECT count(*) FILTER (a_wins = (a.rank < b.rank)) AS n_consistent, count(*) FILTER (a_wins <> (a.rank < b.rank)) AS n_inconsistent
  FROM edges JOIN ranks a ON a.strain = strain_a JOIN ranks b ON b.strain = strain_b)
SELECT n_consistent, n_inconsistent, round((n_consistent - n_inconsistent) / (n_consistent + n_inconsistent), 6) AS dci FROM s""",
)
def dci(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    return scoring.directional_consistency(edges, scoring.win_ranks(edges)).select("n_consistent", "n_inconsistent", r6("dci").alias("dci"))


@query(
    "triads",
    f"""WITH {WINS}, t AS (SELECT x.a_wins AS ab, y.a_wins AS bc, z.a_wins AS ac FROM edges x JOIN edges y ON x.strain_b = y.strain_a JOIN edges z ON z.strain_a = x.strain_a AND z.strain_b = y.strain_b),
s AS (SELECT count(*) AS n_triads, count(*) FILTER ((ab AND bc AND NOT ac) OR (NOT ab AND NOT bc AND ac)) AS n_cyclic FROM t)
SELECT n_triads, n_cyclic, round(n_cyclic / n_triads, 6) AS cyclic_frac FROM s""",
)
def triads(spark, sf_dir):
    return scoring.intransitive_triads(_edges(spark, sf_dir)).select("n_triads", "n_cyclic", r6("cyclic_frac").alias("cyclic_frac"))


@query("pooled_counts", f"WITH {SUPPLIER_WELLS} SELECT strain_a, strain_b, CAST(sum(n1) AS BIGINT) AS n_reads_a, CAST(sum(n2) AS BIGINT) AS n_reads_b FROM swells GROUP BY 1, 2 HAVING sum(n1) + sum(n2) > 0")
def pooled_counts(spark, sf_dir):
    return scoring.pooled_counts(supplier_wells(spark, sf_dir))


@query(
    "win_from_pooled",
    f"WITH {SUPPLIER_WELLS}, p AS (SELECT strain_a, strain_b, sum(n1) / (sum(n1) + sum(n2)) AS s FROM swells GROUP BY 1, 2) SELECT strain_a, strain_b, CASE WHEN s > 0.5 THEN 1.0 WHEN s < 0.5 THEN 0.0 ELSE 0.5 END AS outcome FROM p",
)
def win_from_pooled(spark, sf_dir):
    p = scoring.pooled_counts(supplier_wells(spark, sf_dir))
    return p.select("strain_a", "strain_b", scoring.outcome(F.col("n_reads_a") / (F.col("n_reads_a") + F.col("n_reads_b"))).alias("outcome"))


def _order_pairs(spark, sf_dir):
    """Supplier pairs that share an order."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    other = lines.select("l_orderkey", F.col("l_suppkey").alias("b"))
    return lines.select("l_orderkey", F.col("l_suppkey").alias("a")).join(other, "l_orderkey").filter("a < b").select("a", "b").distinct()


ORDER_COMPONENTS = """RECURSIVE e AS (
  SELECT DISTINCT x.l_suppkey AS a, y.l_suppkey AS b FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_suppkey < y.l_suppkey
), both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach AS (SELECT a AS v, a AS r FROM both_ways UNION SELECT reach.v, b FROM reach JOIN both_ways ON reach.r = both_ways.a),
comp AS (SELECT v AS vertex, min(r) AS component FROM reach GROUP BY 1)"""


@query("components", f"WITH {ORDER_COMPONENTS} SELECT vertex, component FROM comp")
def components(spark, sf_dir):
    return connected_components(_order_pairs(spark, sf_dir), "a", "b")


@query(
    "component_sizes",
    f"WITH {ORDER_COMPONENTS} SELECT component, count(*) AS n_members, CAST(row_number() OVER (ORDER BY count(*) DESC, component) AS INTEGER) AS component_rank FROM comp GROUP BY 1",
)
def component_sizes(spark, sf_dir):
    from pyspark.sql import Window

    sizes = connected_components(_order_pairs(spark, sf_dir), "a", "b").groupBy("component").agg(F.count("*").alias("n_members"))
    return sizes.withColumn("component_rank", F.row_number().over(Window.orderBy(F.desc("n_members"), "component")))


@query(
    "main_component_pairs",
    f"WITH {ORDER_COMPONENTS}, main AS (SELECT component FROM comp GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1) SELECT a AS strain_a, b AS strain_b FROM e JOIN comp ON a = vertex JOIN main USING (component)",
)
def main_component_pairs(spark, sf_dir):
    edges = _order_pairs(spark, sf_dir).toDF("strain_a", "strain_b")
    return scoring.in_component(edges, scoring.main_component(edges))


@query(
    "qc_status",
    """WITH w AS (SELECT l_orderkey AS sample_id, count(*) AS n, count(*) FILTER (l_returnflag = 'A') AS n1, CASE WHEN count(DISTINCT l_suppkey) > 1 THEN count(*) FILTER (l_returnflag = 'N') END AS n2, CASE WHEN count(DISTINCT l_suppkey) = 1 THEN 'mono' ELSE 'pair' END AS well_type FROM lineitem GROUP BY 1),
c AS (SELECT *, greatest(3, CAST(ceil(0.1 * n) AS BIGINT)) AS cutoff FROM w)
SELECT sample_id, cutoff AS qc_cutoff_reads, CASE WHEN well_type = 'mono' THEN CASE WHEN coalesce(n1 >= cutoff, false) THEN 'mono_confirmed' ELSE 'mono_low_confidence' END
  WHEN coalesce(n1 >= cutoff, false) AND coalesce(n2 >= cutoff, false) THEN 'pair_both_confirmed' WHEN coalesce(n1 >= cutoff, false) OR coalesce(n2 >= cutoff, false) THEN 'pair_single_dominant' ELSE 'pair_neither_confirmed' END AS qc_status FROM c""",
)
def qc_status(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    several = F.count_distinct("l_suppkey") > 1
    w = lines.groupBy(F.col("l_orderkey").alias("sample_id")).agg(
        F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "A").alias("n1"), F.when(several, F.count_if(F.col("l_returnflag") == "N")).alias("n2"), F.when(several, "pair").otherwise("mono").alias("well_type")
    )
    return w.select("sample_id", quality.read_cutoff(F.col("n")).alias("qc_cutoff_reads"), quality.qc_status(F.col("well_type"), F.col("n"), F.col("n1"), F.col("n2")).alias("qc_status"))


@query(
    "contam_top_other",
    """WITH c AS (SELECT user_id, event_type AS hit, event_type = 'click' AS expected, count(*) AS n FROM events GROUP BY 1, 2),
o AS (SELECT user_id, hit, n, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, hit) AS k FROM c WHERE NOT expected),
s AS (SELECT user_id, CAST(sum(n) AS BIGINT) AS n_reads, sum(CASE WHEN expected THEN n ELSE 0 END) AS ne FROM c GROUP BY 1)
SELECT user_id, n_reads, round(ne / n_reads, 6) AS frac_expected, hit AS top_other, coalesce(n, 0) AS top_other_count, round(coalesce(n, 0) / n_reads, 6) AS top_other_frac,
  coalesce(n, 0) / n_reads >= 0.2 AND coalesce(n, 0) >= 3 AS contaminated FROM s LEFT JOIN o USING (user_id) WHERE k = 1 OR k IS NULL""",
)
def contam_top_other(spark, sf_dir):
    s = quality.best_hit_summary(table(spark, sf_dir, "events"), by="user_id", hit="event_type", expected=F.col("event_type") == "click")
    flag = quality.contaminated(F.col("top_other_frac"), F.col("top_other_count"))
    return s.select("user_id", "n_reads", r6("frac_expected").alias("frac_expected"), "top_other", "top_other_count", r6("top_other_frac").alias("top_other_frac"), flag.alias("contaminated"))


@query(
    "confident_summary",
    """WITH r AS (SELECT o_custkey AS sample_id, o_orderstatus AS best_match, o_totalprice / 524288 AS best_dist FROM orders)
SELECT sample_id, count(*) FILTER (best_dist < 0.5 AND best_match = 'O') AS n_conf_strain1, CAST(NULL AS BIGINT) AS n_conf_strain2, round(count(*) FILTER (best_dist < 0.5 AND best_match = 'O') / count(*), 6) AS frac_strain1,
  CAST(NULL AS DOUBLE) AS frac_strain2, round(median(best_dist), 4) AS median_best_dist FROM r GROUP BY 1""",
)
def confident_summary(spark, sf_dir):
    reads = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("sample_id"), F.col("o_orderstatus").alias("best_match"), (F.col("o_totalprice") / 524288).alias("best_dist"))
    reads = reads.withColumns({"strain1": F.lit("O"), "strain2": F.lit("missing"), "candidate1": F.lit("O"), "candidate2": F.lit("F")})
    s = quality.confident_summary(reads, by="sample_id", threshold=0.5)
    return s.select("sample_id", "n_conf_strain1", "n_conf_strain2", r6("frac_strain1").alias("frac_strain1"), r6("frac_strain2").alias("frac_strain2"), F.round("median_best_dist", 4).alias("median_best_dist"))


@query(
    "composition_having",
    """WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), s AS (SELECT *, n / sum(n) OVER (PARTITION BY user_id) AS share FROM c)
SELECT user_id, event_type, n, event_type IN ('click', 'view') AS expected, round(share, 6) AS share FROM s WHERE n >= 2 AND share >= 0.05""",
)
def composition_having(spark, sf_dir):
    out = quality.composition(table(spark, sf_dir, "events"), well="user_id", group="event_type", expected=F.col("event_type").isin("click", "view"))
    return out.select("user_id", "event_type", "n", "expected", r6("share").alias("share"))


@query(
    "distance_class",
    """SELECT p_partkey, CASE WHEN p_size - 1 = 0 THEN 'identical' WHEN p_size - 2 <= 0 THEN 'indistinguishable' WHEN p_size - 2 < 10 THEN 'close' ELSE 'distinguishable' END AS distance_class,
  CASE WHEN p_retailprice < 950 THEN 'no_16S' WHEN p_size / 1000.0 <= 0.002 THEN 'match' WHEN p_size / 1000.0 >= 0.01 THEN 'mismatch' ELSE 'ambiguous' END AS genome_call FROM part""",
)
def distance_class(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    size = F.col("p_size")
    far = F.when(F.col("p_retailprice") >= 950, size / 1000)
    return p.select("p_partkey", quality.distance_class(size - 2, size - 1).alias("distance_class"), quality.genome_call(far).alias("genome_call"))


@query(
    "eligibility_ladder",
    """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_mktsegment = 'MACHINERY' THEN 'segment' WHEN c_nationkey > 20 THEN 'far' END AS reason,
  CASE WHEN c_acctbal < 0 OR c_mktsegment = 'MACHINERY' OR c_nationkey > 20 THEN 'exclude' WHEN c_acctbal > 5000 THEN 'high' ELSE 'medium' END AS tier FROM customer""",
)
def eligibility_ladder(spark, sf_dir):
    reasons = [("debt", F.col("c_acctbal") < 0), ("segment", F.col("c_mktsegment") == "MACHINERY"), ("far", F.col("c_nationkey") > 20)]
    return table(spark, sf_dir, "customer").select("c_custkey", quality.first_reason(reasons).alias("reason"), quality.eligibility(reasons, F.col("c_acctbal") > 5000).alias("tier"))


@query(
    "confidence_tier",
    """WITH x AS (SELECT l_orderkey, l_linenumber, 0.9 + l_discount AS i, l_tax / 20 AS m, l_returnflag = 'A' AS a FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN i >= 0.98 AND m >= 0.002 AND a THEN 'A' WHEN i >= 0.98 AND m >= 0.002 THEN 'B' WHEN i >= 0.93 THEN 'C' ELSE 'D' END AS tier FROM x""",
)
def confidence_tier(spark, sf_dir):
    tier = quality.confidence_tier(F.lit(0.9) + F.col("l_discount"), F.col("l_tax") / 20, F.col("l_returnflag") == "A", strict=0.98, loose=0.93)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", tier.alias("tier"))


@query(
    "odd_one_out",
    """SELECT o_orderkey, CASE WHEN a AND b AND c THEN 'none' WHEN a AND NOT b AND NOT c THEN 'c' WHEN b AND NOT a AND NOT c THEN 'b' WHEN c AND NOT a AND NOT b THEN 'a' WHEN NOT a AND NOT b AND NOT c THEN 'all' ELSE 'inconsistent' END AS odd
FROM (SELECT o_orderkey, o_orderkey % 2 = 0 AS a, o_custkey % 3 = 0 AS b, o_orderstatus = 'F' AS c FROM orders)""",
)
def odd_one_out(spark, sf_dir):
    odd = quality.odd_one_out(F.col("o_orderkey") % 2 == 0, F.col("o_custkey") % 3 == 0, F.col("o_orderstatus") == "F")
    return table(spark, sf_dir, "orders").select("o_orderkey", odd.alias("odd"))


@query(
    "consensus_status",
    """WITH s AS (SELECT l_partkey AS strain, count(*) FILTER (l_returnflag = 'A' AND l_quantity > 40) AS monos, count(*) FILTER (l_returnflag = 'A') AS seen, count(*) FILTER (l_returnflag = 'N' AND l_quantity > 35) AS pw,
  count(*) FILTER (l_quantity > 40) AS w, count(DISTINCT l_suppkey) AS plates FROM lineitem GROUP BY 1)
SELECT strain, CASE WHEN monos >= 2 THEN 'ok_monos_agree' WHEN monos = 1 AND pw >= 2 THEN 'ok_mono_plus_pairs' WHEN monos = 1 AND seen >= 2 THEN 'monos_disagree' WHEN monos = 1 THEN 'mono_only'
  WHEN seen = 0 AND w >= 4 AND plates >= 2 THEN 'ok_pairs_corroborated' WHEN w >= 2 THEN 'pairs_only_weak' ELSE 'single_well' END AS status FROM s""",
)
def consensus_status(spark, sf_dir):
    flag, q = F.col("l_returnflag"), F.col("l_quantity")
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("strain")).agg(
        F.count_if((flag == "A") & (q > 40)).alias("monos"), F.count_if(flag == "A").alias("seen"), F.count_if((flag == "N") & (q > 35)).alias("pw"), F.count_if(q > 40).alias("w"), F.count_distinct("l_suppkey").alias("plates")
    )
    return s.select("strain", quality.consensus_status(*map(F.col, ("monos", "seen", "pw", "w", "plates"))).alias("status"))


@query(
    "majority_status",
    """WITH c AS (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2), t AS (SELECT o_custkey, max(n) AS top, sum(n) AS informative FROM c GROUP BY 1)
SELECT c_custkey, CASE WHEN coalesce(informative, 0) = 0 THEN 'no_data' WHEN informative = 1 THEN 'ok_single_well' WHEN 2 * top > informative THEN 'ok' ELSE 'no_majority' END AS status FROM customer LEFT JOIN t ON o_custkey = c_custkey""",
)
def majority_status(spark, sf_dir):
    c = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("n")).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("n").alias("top"), F.sum("n").alias("informative"))
    both = table(spark, sf_dir, "customer").select("c_custkey").join(c, "c_custkey", "left").na.fill(0, ["top", "informative"])
    return both.select("c_custkey", quality.majority_status(F.col("top"), F.col("informative")).alias("status"))


@query("duplicate_keys", "SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return quality.audit_key(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderpriority"])


@query("one_to_one_join", "SELECT o_orderkey, c_custkey, c_mktsegment FROM (SELECT o_orderkey, o_custkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1) JOIN customer ON c_custkey = o_custkey")
def one_to_one_join(spark, sf_dir):
    first = best(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")), ["c_custkey"], ["o_orderkey"])
    return quality.one_to_one(first, table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), ["c_custkey"]).select("o_orderkey", "c_custkey", "c_mktsegment")


@query(
    "within_pair_replicates",
    f"WITH {SUPPLIER_WELLS} SELECT x.strain_a, x.strain_b, count(*) AS n_couples, round(avg(abs(x.lr - y.lr)), 6) AS mean_gap FROM swells x JOIN swells y ON x.strain_a = y.strain_a AND x.strain_b = y.strain_b AND x.l_orderkey < y.l_orderkey GROUP BY 1, 2",
)
def within_pair_replicates(spark, sf_dir):
    couples = pairs.within_pair_replicates(supplier_wells(spark, sf_dir), id_col="l_orderkey")
    return couples.groupBy("strain_a", "strain_b").agg(F.count("*").alias("n_couples"), r6(F.avg(F.abs(F.col("x") - F.col("y")))).alias("mean_gap"))


@query(
    "across_experiments",
    f"""WITH {SUPPLIER_WELLS}, a AS (SELECT * FROM swells WHERE l_orderkey % 2 = 0), b AS (SELECT * FROM swells WHERE l_orderkey % 2 = 1), m AS (SELECT strain_a, strain_b, avg(lr) AS x FROM a GROUP BY 1, 2), n AS (SELECT strain_a, strain_b, avg(lr) AS y FROM b GROUP BY 1, 2)
SELECT count(*) AS n_pairs, round(1 - sum((y - x) * (y - x)) / sum((y - (SELECT avg(y) FROM m JOIN n USING (strain_a, strain_b))) * (y - (SELECT avg(y) FROM m JOIN n USING (strain_a, strain_b)))), 6) AS r2_identity, round(corr(x, y) * corr(x, y), 6) AS r2_linear, round(regr_slope(y, x), 6) AS slope,
  round(avg(CASE WHEN (x > 0) = (y > 0) THEN 1.0 ELSE 0.0 END), 6) AS winner_agreement FROM m JOIN n USING (strain_a, strain_b)""",
)
def across_experiments(spark, sf_dir):
    from tessera.operators.stats import identity_metrics

    wells = supplier_wells(spark, sf_dir)
    means = [wells.filter(F.col("l_orderkey") % 2 == k).groupBy("strain_a", "strain_b").agg(F.avg("log2_ratio_a_over_b").alias("log2_ratio_a_over_b")) for k in (0, 1)]
    m = identity_metrics(pairs.across_pair_replicates(*means), "x", "y", [])
    return m.select(F.col("n").alias("n_pairs"), *[r6(c).alias(c) for c in ("r2_identity", "r2_linear", "slope", "winner_agreement")])
