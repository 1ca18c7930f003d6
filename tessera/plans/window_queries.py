"""Windows, bins, crosstabs, funnels and set operations on the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import windows as W
from tessera.operators.tables import crosstab_shares, hourly_trend, set_overlap, step_counts, unpivot_cells

from .registry import query
from .tables import r6, table


@query("plate_zscore", "SELECT event_id, event_type, round((value - avg(value) OVER w) / stddev_pop(value) OVER w, 6) AS z FROM events WINDOW w AS (PARTITION BY event_type)")
def plate_zscore(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "event_type", r6(W.zscore("value", ["event_type"])).alias("z"))


@query(
    "row_col_detrend",
    """WITH g AS (SELECT l_linestatus AS plate, l_linenumber AS r, l_returnflag AS c, avg(l_quantity) AS x FROM lineitem GROUP BY 1, 2, 3)
SELECT plate, r, c, round(x - avg(x) OVER (PARTITION BY plate, r) - avg(x) OVER (PARTITION BY plate, c) + avg(x) OVER (PARTITION BY plate), 6) AS residual FROM g""",
)
def row_col_detrend(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linestatus").alias("plate"), F.col("l_linenumber").alias("r"), F.col("l_returnflag").alias("c")).agg(F.avg("l_quantity").alias("x"))
    return g.select("plate", "r", "c", r6(W.detrend("x", ["plate"], "r", "c")).alias("residual"))


@query(
    "growth_parameters",
    """WITH s AS (SELECT user_id, event_id, greatest(value, 0.001) AS v, value FROM events), l AS (SELECT user_id, event_id, value, (ln(v) - lag(ln(v), 4) OVER (PARTITION BY user_id ORDER BY event_id)) / 4 AS slope FROM s)
SELECT user_id, round(max(value), 6) AS max_od, round(arg_max(value, event_id) - arg_min(value, event_id), 6) AS delta_od, round(max(slope), 6) AS max_log_slope FROM l GROUP BY 1""",
)
def growth_parameters(spark, sf_dir):
    g = W.growth_parameters(table(spark, sf_dir, "events"), by=["user_id"], order="event_id", od="value")
    return g.select("user_id", *[r6(c).alias(c) for c in ("max_od", "delta_od", "max_log_slope")])


@query("rolling15", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 14 PRECEDING AND CURRENT ROW), 6) AS rolling_mean FROM events")
def rolling15(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", r6(W.rolling_mean("value", ["user_id"], ["event_id"])).alias("rolling_mean"))


@query("cum_before", "SELECT l_orderkey, l_linenumber, coalesce(sum(l_quantity) OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS drawn_before FROM lineitem")
def cum_before(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", W.sum_before("l_quantity", ["l_partkey"], ["l_shipdate", "l_orderkey", "l_linenumber"]).alias("drawn_before"))


@query("worst_per_group", "SELECT c_nationkey, c_custkey, c_acctbal FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) <= 8")
def worst_per_group(spark, sf_dir):
    return W.best(table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_acctbal"), ["c_nationkey"], ["c_acctbal", "c_custkey"], 8)


@query(
    "runner_up_margin",
    "SELECT ps AS l_partkey, l_orderkey, l_linenumber, round(nxt - l_extendedprice, 6) AS margin FROM (SELECT l_partkey AS ps, l_orderkey, l_linenumber, l_extendedprice, lead(l_extendedprice) OVER w AS nxt, row_number() OVER w AS k FROM lineitem WINDOW w AS (PARTITION BY l_partkey ORDER BY l_extendedprice, l_orderkey, l_linenumber)) WHERE k = 1",
)
def runner_up_margin(spark, sf_dir):
    w = Window.partitionBy("l_partkey").orderBy("l_extendedprice", "l_orderkey", "l_linenumber")
    t = table(spark, sf_dir, "lineitem").withColumns({"_next": F.lead("l_extendedprice").over(w), "_k": F.row_number().over(w)}).filter("_k = 1")
    return t.select("l_partkey", "l_orderkey", "l_linenumber", r6(F.col("_next") - F.col("l_extendedprice")).alias("margin"))


@query("group_size_column", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n_orders FROM orders")
def group_size_column(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.count("*").over(Window.partitionBy("o_custkey")).alias("n_orders"))


@query("ntile20", "SELECT p_partkey, CAST(ntile(20) OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS INTEGER) AS bin FROM part")
def ntile20(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", W.quantile_bins("p_retailprice", ["p_brand"], 20, ["p_partkey"]).alias("bin"))


@query(
    "right_closed_bins",
    """WITH b AS (SELECT CASE WHEN p_size > 0 AND p_size <= 5 THEN 0 WHEN p_size > 5 AND p_size <= 10 THEN 1 WHEN p_size > 10 AND p_size <= 25 THEN 2 WHEN p_size > 25 AND p_size <= 50 THEN 3 END AS bin, p_retailprice AS x FROM part)
SELECT bin, count(*) AS n, round(median(x), 4) AS median, round(quantile_cont(x, 0.9), 4) AS p90, round(quantile_cont(x, 0.95), 4) AS p95 FROM b GROUP BY 1""",
)
def right_closed_bins(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("bin", W.right_closed_bin(F.col("p_size"), [0, 5, 10, 25, 50]))
    x = "p_retailprice"
    return p.groupBy("bin").agg(F.count("*").alias("n"), F.round(F.median(x), 4).alias("median"), F.round(F.percentile(x, F.lit(0.9)), 4).alias("p90"), F.round(F.percentile(x, F.lit(0.95)), 4).alias("p95"))


@query(
    "left_closed_bins",
    "SELECT CASE WHEN l_quantity >= 0 AND l_quantity < 10 THEN 0 WHEN l_quantity >= 10 AND l_quantity < 20 THEN 1 WHEN l_quantity >= 20 AND l_quantity < 50 THEN 2 END AS bin, count(*) AS n FROM lineitem GROUP BY 1",
)
def left_closed_bins(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(W.left_closed_bin(F.col("l_quantity"), [0, 10, 20, 50]).alias("bin")).agg(F.count("*").alias("n"))


@query(
    "accuracy_curve",
    "SELECT CASE WHEN p_size BETWEEN 1 AND 2 THEN '1-2' WHEN p_size BETWEEN 3 AND 5 THEN '3-5' WHEN p_size BETWEEN 6 AND 10 THEN '6-10' WHEN p_size BETWEEN 11 AND 20 THEN '11-20' WHEN p_size BETWEEN 21 AND 40 THEN '21-40' END AS bin, count(*) AS n, round(avg(CASE WHEN p_retailprice > 1200 THEN 1.0 ELSE 0.0 END), 6) AS share_correct FROM part GROUP BY 1",
)
def accuracy_curve(spark, sf_dir):
    bins = [(1, 2), (3, 5), (6, 10), (11, 20), (21, 40)]
    p = table(spark, sf_dir, "part").withColumn("bin", W.inclusive_bin(F.col("p_size"), bins))
    return p.groupBy("bin").agg(F.count("*").alias("n"), r6(F.avg((F.col("p_retailprice") > 1200).cast("double"))).alias("share_correct"))


@query(
    "margin_rule_scan",
    "SELECT t AS min_bp, count(*) AS n, round(avg(CASE WHEN l_returnflag = 'A' THEN 1.0 ELSE 0.0 END), 6) AS share_correct FROM lineitem JOIN (SELECT unnest([1, 3, 6, 8, 10, 12, 15, 20]) AS t) ON l_quantity >= t GROUP BY 1",
)
def margin_rule_scan(spark, sf_dir):
    thresholds = F.array(*map(F.lit, (1, 3, 6, 8, 10, 12, 15, 20)))
    x = table(spark, sf_dir, "lineitem").select("l_returnflag", F.explode(F.filter(thresholds, lambda t: F.col("l_quantity") >= t)).alias("min_bp"))
    return x.groupBy("min_bp").agg(F.count("*").alias("n"), r6(F.avg((F.col("l_returnflag") == "A").cast("double"))).alias("share_correct"))


@query(
    "threshold_sweep",
    "SELECT l_returnflag, t AS threshold, round(100.0 * sum(CASE WHEN l_extendedprice >= t THEN 1 ELSE 0 END) / count(*), 6) AS pct FROM lineitem CROSS JOIN (SELECT unnest([10000, 20000, 40000]) AS t) GROUP BY 1, 2",
)
def threshold_sweep(spark, sf_dir):
    limits = (10000, 20000, 40000)
    t = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(*[(100.0 * F.count_if(F.col("l_extendedprice") >= k) / F.count("*")).alias(f"t{k}") for k in limits])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("threshold"), F.col(f"t{k}").alias("pct")) for k in limits])).alias("x")
    return t.select("l_returnflag", rows).select("l_returnflag", "x.threshold", r6("x.pct").alias("pct"))


@query(
    "weighted_median",
    """WITH s AS (SELECT l_partkey, l_extendedprice AS x, sum(l_quantity) OVER (PARTITION BY l_partkey ORDER BY l_extendedprice) / sum(l_quantity) OVER (PARTITION BY l_partkey) AS share FROM lineitem)
SELECT l_partkey, round(min(x), 4) AS weighted_median FROM s WHERE share >= 0.5 GROUP BY 1""",
)
def weighted_median(spark, sf_dir):
    out = W.weighted_median(table(spark, sf_dir, "lineitem"), by=["l_partkey"], value="l_extendedprice", weight="l_quantity")
    return out.select("l_partkey", F.round("weighted_median", 4).alias("weighted_median"))


@query(
    "hourly_trend",
    "SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour, count(*) AS n, round(avg(CASE WHEN event_type = 'click' THEN 1.0 ELSE 0.0 END), 6) AS share_click, round(median(value), 4) AS median_value, count(DISTINCT user_id) AS n_users FROM events GROUP BY 1",
)
def hourly(spark, sf_dir):
    t = hourly_trend(table(spark, sf_dir, "events"), time="ts", value="value", unit="user_id", good=F.col("event_type") == "click")
    return t.select("hour", "n", r6("share_good").alias("share_click"), F.round("median_value", 4).alias("median_value"), F.col("n_units").alias("n_users"))


@query(
    "crosstab_norm",
    """WITH c AS (SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1)
SELECT o_orderpriority, n, round(f / n, 6) AS "F", round(o / n, 6) AS "O", round(p / n, 6) AS "P" FROM c""",
)
def crosstab_norm(spark, sf_dir):
    c = crosstab_shares(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])
    return c.select("o_orderpriority", "n", *[r6(x).alias(x) for x in ("F", "O", "P")])


@query(
    "cube_margin",
    "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_returnflag) * 2 + grouping(l_linestatus) AS BIGINT) AS level FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
)
def cube_margin(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


@query("pivot_wide", "SELECT l_suppkey, round(avg(l_quantity) FILTER (l_linenumber = 1), 6) AS w1, round(avg(l_quantity) FILTER (l_linenumber = 2), 6) AS w2, round(avg(l_quantity) FILTER (l_linenumber = 3), 6) AS w3 FROM lineitem GROUP BY 1")
def pivot_wide(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").pivot("l_linenumber", [1, 2, 3]).agg(F.avg("l_quantity"))
    return p.select("l_suppkey", *[r6(F.col(f"`{k}`")).alias(f"w{k}") for k in (1, 2, 3)])


@query("unpivot_long", "SELECT o_orderkey, 'custkey' AS feature, CAST(o_custkey AS DOUBLE) AS value FROM orders UNION ALL SELECT o_orderkey, 'total', o_totalprice FROM orders")
def unpivot_long(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("double").alias("custkey"), F.col("o_totalprice").alias("total"))
    return unpivot_cells(o, ["o_orderkey"], ["custkey", "total"])


@query("median_plate", "SELECT l_suppkey, l_linenumber, median(l_quantity) AS od FROM lineitem GROUP BY 1, 2")
def median_plate(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.median("l_quantity").alias("od"))


@query(
    "representative_unit",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_acctbal DESC, c_name) AS k FROM customer)
SELECT c_nationkey, c_mktsegment, max(c_name) FILTER (k = 1) AS representative, count(*) - 1 AS n_mates FROM r GROUP BY 1, 2""",
)
def representative_unit(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    pick = F.min_by("c_name", F.struct((-F.col("c_acctbal")).alias("a"), "c_name"))
    return c.groupBy("c_nationkey", "c_mktsegment").agg(pick.alias("representative"), (F.count("*") - 1).alias("n_mates"))


@query("step_funnel", "SELECT 1 AS step, 'all' AS name, count(*) AS n FROM orders UNION ALL SELECT 2, 'finished', count(*) FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 3, 'large', count(*) FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def step_funnel(spark, sf_dir):
    return step_counts(table(spark, sf_dir, "orders"), [("all", F.lit(True)), ("finished", F.col("o_orderstatus") == "F"), ("large", F.col("o_totalprice") > 100000)])


@query(
    "setops_overlap",
    "SELECT count(*) FILTER (a AND b) AS n_both, count(*) FILTER (a AND NOT b) AS n_left, count(*) FILTER (b AND NOT a) AS n_right FROM (SELECT bool_or(s = 1) AS a, bool_or(s = 2) AS b FROM (SELECT DISTINCT c_custkey AS k, 1 AS s FROM customer WHERE c_acctbal > 0 UNION ALL SELECT DISTINCT o_custkey, 2 FROM orders WHERE o_totalprice > 200000) GROUP BY k)",
)
def setops_overlap(spark, sf_dir):
    a = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    b = table(spark, sf_dir, "orders").filter("o_totalprice > 200000").select(F.col("o_custkey").alias("k"))
    return set_overlap(a, b)


@query("strain_universe", "SELECT n_nationkey AS strain, max(CASE WHEN s = 1 THEN 1 ELSE 0 END) AS in_a, max(CASE WHEN s = 2 THEN 1 ELSE 0 END) AS in_b FROM nation JOIN (SELECT c_nationkey AS k, 1 AS s FROM customer UNION SELECT s_nationkey, 2 FROM supplier) ON k = n_nationkey GROUP BY 1")
def strain_universe(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("strain"), F.lit(1).alias("s"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("strain"), F.lit(2).alias("s"))
    has = lambda k: F.max((F.col("s") == k).cast("int"))
    return a.unionByName(b).groupBy("strain").agg(has(1).alias("in_a"), has(2).alias("in_b"))


@query("multiset_difference", "SELECT o_orderpriority, o_orderstatus FROM orders WHERE o_orderkey % 2 = 0 EXCEPT ALL SELECT o_orderpriority, o_orderstatus FROM orders WHERE o_orderkey % 2 = 1")
def multiset_difference(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    side = lambda k: o.filter(F.col("o_orderkey") % 2 == k).select("o_orderpriority", "o_orderstatus")
    return side(0).exceptAll(side(1))


@query(
    "jaccard_features",
    """WITH f AS (SELECT DISTINCT l_suppkey AS s, o_custkey AS g FROM orders JOIN lineitem ON l_orderkey = o_orderkey), n AS (SELECT s, count(*) AS n FROM f GROUP BY 1),
p AS (SELECT x.s AS a, y.s AS b, count(*) AS shared FROM f x JOIN f y ON x.g = y.g AND x.s < y.s GROUP BY 1, 2)
SELECT a, b, shared, na.n - shared AS only_a, nb.n - shared AS only_b, round(shared / (na.n + nb.n - shared), 6) AS jaccard FROM p JOIN n na ON na.s = a JOIN n nb ON nb.s = b""",
)
def jaccard_features(spark, sf_dir):
    from tessera.operators.features import shared_features

    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("feature"), F.col("o_orderkey").alias("l_orderkey"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("strain"))
    return shared_features(o.join(lines, "l_orderkey").select("strain", "feature")).select("a", "b", "shared", "only_a", "only_b", r6("jaccard").alias("jaccard"))


@query(
    "prevalence_filter",
    """WITH f AS (SELECT l_suppkey AS strain, l_partkey AS feature, sum(l_quantity) AS cnt FROM lineitem GROUP BY 1, 2), p AS (SELECT feature, count(*) AS n FROM f GROUP BY 1 HAVING count(*) >= 20 AND count(*) <= (SELECT count(DISTINCT strain) FROM f) - 20)
SELECT strain, count(*) AS n_features, sum(cnt) AS total FROM f JOIN p USING (feature) GROUP BY 1""",
)
def prevalence_filter(spark, sf_dir):
    from tessera.operators.features import prevalent

    f = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("strain"), F.col("l_partkey").alias("feature")).agg(F.sum("l_quantity").alias("cnt"))
    return prevalent(f, 20).groupBy("strain").agg(F.count("*").alias("n_features"), F.sum("cnt").alias("total"))


@query("json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("sampled_files", "SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS k FROM lineitem) WHERE k <= 25")
def sampled_files(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber")
    return W.best(lines, ["l_suppkey"], ["l_orderkey", "l_linenumber"], 25).drop("l_suppkey")
