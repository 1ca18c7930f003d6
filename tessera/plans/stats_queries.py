"""Statistics, tests, folds and controls on the driver tables."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from tessera.functions.draws import uniform_sql
from tessera.operators import folds, pairs, scoring, stats
from tessera.operators import windows as W
from tessera.operators.tables import canonical_matrix, merged_counts, same_rows, share_dispersion
from tessera.storage import materialize

from .registry import query
from .tables import SUPPLIER_WELLS, r6, supplier_wells, table


@query(
    "spearman",
    """WITH r AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2 AS rx, rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2 AS ry FROM lineitem)
SELECT l_returnflag, round(corr(rx, ry), 6) AS spearman_rho, count(*) AS n FROM r GROUP BY 1""",
)
def spearman(spark, sf_dir):
    return stats.spearman(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"]).withColumn("spearman_rho", r6("spearman_rho"))


def _predicted(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return lines.select("l_returnflag", ((F.col("l_quantity") - 25) / 10).alias("y"), ((F.col("l_extendedprice") - 50000) / 20000).alias("yhat"))


PRED = "p AS (SELECT l_returnflag, (l_quantity - 25) / 10 AS y, (l_extendedprice - 50000) / 20000 AS yhat FROM lineitem)"


@query(
    "metrics_r2_zero",
    f"""WITH {PRED} SELECT l_returnflag, count(*) AS n, round(1 - sum((y - yhat) * (y - yhat)) / sum(y * y), 6) AS r2, round(avg(abs(y - yhat)), 6) AS mae, round(corr(y, yhat), 6) AS pearson_r,
  count(*) FILTER (abs(y) > 1) AS n_sign_evaluated, round(avg(CASE WHEN sign(y) = sign(yhat) THEN 1.0 ELSE 0.0 END) FILTER (abs(y) > 1), 6) AS sign_accuracy FROM p GROUP BY 1""",
)
def metrics_r2_zero(spark, sf_dir):
    m = stats.metrics_vs_zero(_predicted(spark, sf_dir), "y", "yhat", ["l_returnflag"])
    return m.select("l_returnflag", "n", *[r6(c).alias(c) for c in ("r2", "mae", "pearson_r")], "n_sign_evaluated", r6("sign_accuracy").alias("sign_accuracy"))


@query("metrics_r2_mean", f"WITH {PRED} SELECT l_returnflag, count(*) AS n, round(1 - sum((y - yhat) * (y - yhat)) / (var_pop(y) * count(*)), 6) AS r2, round(avg(abs(y - yhat)), 6) AS mae, round(corr(y, yhat), 6) AS pearson_r FROM p GROUP BY 1")
def metrics_r2_mean(spark, sf_dir):
    m = stats.metrics_vs_mean(_predicted(spark, sf_dir), "y", "yhat", ["l_returnflag"])
    return m.select("l_returnflag", "n", *[r6(c).alias(c) for c in ("r2", "mae", "pearson_r")])


@query("r2_zero_plain", f"WITH {PRED} SELECT round(1 - sum((y - yhat) * (y - yhat)) / sum(y * y), 6) AS r2 FROM p")
def r2_zero_plain(spark, sf_dir):
    return _predicted(spark, sf_dir).agg(r6(stats.r2_vs_zero(F.col("y"), F.col("yhat"))).alias("r2"))


@query(
    "titration_slope",
    "SELECT l_partkey, count(DISTINCT l_quantity) AS n_levels, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_quantity) >= 4",
)
def titration_slope(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(
        F.count_distinct("l_quantity").alias("n_levels"), F.round(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"), F.round(F.regr_intercept("l_extendedprice", "l_quantity"), 4).alias("intercept"), r6(F.regr_r2("l_extendedprice", "l_quantity")).alias("r2")
    )
    return g.filter("n_levels >= 4")


@query(
    "overdispersion",
    "WITH c AS (SELECT l_suppkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS k FROM lineitem GROUP BY 1), p AS (SELECT sum(k) / sum(n) AS p FROM c) SELECT count(*) AS levels, round(p, 6) AS rate, round(sum((k - n * p) * (k - n * p) / (n * p * (1 - p))), 4) AS chi2, round(sum((k - n * p) * (k - n * p) / (n * p * (1 - p))) / (count(*) - 1), 6) AS dispersion FROM c, p GROUP BY p",
)
def overdispersion(spark, sf_dir):
    d = stats.dispersion(table(spark, sf_dir, "lineitem"), "l_suppkey", F.col("l_returnflag") == "R")
    return d.select("levels", r6("rate").alias("rate"), F.round("chi2", 4).alias("chi2"), r6("dispersion").alias("dispersion"))


@query(
    "exact_factor_tests",
    """WITH c AS (SELECT l_suppkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS k FROM lineitem GROUP BY 1), o AS (SELECT *, sum(k) OVER () / sum(n) OVER () AS p0 FROM c),
m AS (SELECT l_suppkey, i, lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(p0) + (n - i) * ln(1 - p0) AS lp FROM o, LATERAL (SELECT unnest(generate_series(0, n)) AS i)),
t AS (SELECT o.l_suppkey, least(1.0, sum(exp(m.lp)) FILTER (m.lp <= x.lp + 1e-7)) AS p FROM o JOIN m USING (l_suppkey) JOIN m x ON x.l_suppkey = o.l_suppkey AND x.i = o.k GROUP BY 1),
r AS (SELECT l_suppkey, p, p * count(*) OVER () / (rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1) AS raw FROM t)
SELECT l_suppkey, n, k, round(p0, 6) AS p0, round(k / n, 6) AS rate, round(p, 6) AS p_value, round(least(1.0, min(raw) OVER (ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q_value FROM o JOIN r USING (l_suppkey)""",
)
def exact_factor_tests(spark, sf_dir):
    out = stats.overdispersion(table(spark, sf_dir, "lineitem"), "l_suppkey", F.col("l_returnflag") == "R")
    return out.select("l_suppkey", "n", "k", *[r6(c).alias(c) for c in ("p0", "rate", "p_value", "q_value")])


@query(
    "bh_q_values",
    "WITH x AS (SELECT c_custkey, c_nationkey, (c_custkey * 37 % 1009) / 1009.0 AS p FROM customer), r AS (SELECT *, p * count(*) OVER (PARTITION BY c_nationkey) / (rank() OVER (PARTITION BY c_nationkey ORDER BY p) + count(*) OVER (PARTITION BY c_nationkey, p) - 1) AS raw FROM x) SELECT c_custkey, round(least(1.0, min(raw) OVER (PARTITION BY c_nationkey ORDER BY p DESC)), 6) AS q, round(least(1.0, raw), 6) AS q_plain FROM r",
)
def bh_q_values(spark, sf_dir):
    x = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", ((F.col("c_custkey") * 37 % 1009) / 1009.0).alias("p"))
    x = W.with_q_values(x, "p", ["c_nationkey"])
    return W.with_q_values(x, "p", ["c_nationkey"], step_up=False, name="q_plain").select("c_custkey", r6("q").alias("q"), r6("q_plain").alias("q_plain"))


@query("closed_histogram", "SELECT CAST(least(floor(value / 100 * 80), 79) AS INTEGER) AS bin, count(*) AS n FROM events WHERE value BETWEEN 0 AND 100 GROUP BY 1")
def closed_histogram(spark, sf_dir):
    return stats.histogram(table(spark, sf_dir, "events"), "value", low=0.0, high=100.0, bins=80)


@query(
    "valley_threshold",
    """WITH x AS (SELECT value / (abs(max(value) OVER (PARTITION BY event_type)) + 1) * 0.4 AS d FROM events), t AS (SELECT greatest(0.4, max(d)) AS top FROM x),
h AS (SELECT CAST(least(floor(d / top * 80), 79) AS INTEGER) AS bin, count(*) AS n FROM x, t WHERE d >= 0 GROUP BY 1), c AS (SELECT (i + 0.5) * top / 80 AS centre, coalesce(n, 0) AS n FROM generate_series(0, 79) g(i) CROSS JOIN t LEFT JOIN h ON bin = i),
e AS (SELECT centre FROM c WHERE centre BETWEEN 0.04 AND 0.2 AND n <= greatest(1, 0.02 * (SELECT max(n) FROM c))) SELECT round_even(coalesce((SELECT median(centre) FROM e), (SELECT median(d) FROM x)), 3) AS threshold""",
)
def valley_threshold(spark, sf_dir):
    x = table(spark, sf_dir, "events").select((F.col("value") / (F.abs(F.max("value").over(W.Window.partitionBy("event_type"))) + 1) * 0.4).alias("d"))
    cut = stats.valley_threshold(x, "d", lo=0.04, hi=0.2)
    return spark.createDataFrame([(cut,)], "threshold double")


@query(
    "binomial_z",
    "WITH c AS (SELECT l_suppkey, count(*) FILTER (l_linestatus = 'F') AS n1, count(*) FILTER (l_linestatus = 'F' AND l_returnflag = 'A') AS k1, count(*) FILTER (l_linestatus = 'O') AS n2, count(*) FILTER (l_linestatus = 'O' AND l_returnflag = 'A') AS k2 FROM lineitem GROUP BY 1), p AS (SELECT *, (k1 + k2) / (n1 + n2) AS p FROM c) SELECT l_suppkey, round((k1 / n1 - k2 / n2) / sqrt(p * (1 - p) * (1 / n1 + 1 / n2)), 6) AS z FROM p",
)
def binomial_z(spark, sf_dir):
    f, a = F.col("l_linestatus") == "F", F.col("l_returnflag") == "A"
    c = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count_if(f).alias("n1"), F.count_if(f & a).alias("k1"), F.count_if(~f).alias("n2"), F.count_if(~f & a).alias("k2"))
    return c.select("l_suppkey", r6(stats.binomial_z(*map(F.col, ("k1", "n1", "k2", "n2")))).alias("z"))


@query(
    "split_half",
    "WITH k AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events), s AS (SELECT user_id, max(value) FILTER (k = 1) AS f, avg(value) FILTER (k > 1) AS r FROM k GROUP BY 1 HAVING count(*) > 1) SELECT count(*) AS n_units, round(corr(f, r), 6) AS pearson_r, round(3 * corr(f, r) / (1 + 2 * corr(f, r)), 6) AS reliability_of_three FROM s",
)
def split_half(spark, sf_dir):
    s = stats.split_half(table(spark, sf_dir, "events"), unit="user_id", order="event_id", value="value")
    out = s.agg(F.count("*").alias("n_units"), stats.correlation("first", "rest").alias("r"))
    return out.select("n_units", r6("r").alias("pearson_r"), r6(stats.spearman_brown(F.col("r"), F.lit(3.0))).alias("reliability_of_three"))


@query(
    "label_noise_ceiling",
    f"WITH {SUPPLIER_WELLS}, v AS (SELECT avg(slr * slr) AS noise, avg(1.0 / n_replicates) AS inv FROM spairs WHERE n_replicates > 1), t AS (SELECT var_pop(mlr) AS total FROM spairs) SELECT round(total, 6) AS pair_variance, round(noise, 6) AS noise_variance, round(1 - noise * inv / total, 6) AS ceiling FROM v, t",
)
def label_noise_ceiling(spark, sf_dir):
    s = scoring.replicate_stability(supplier_wells(spark, sf_dir))
    several = F.col("n_replicates") > 1
    sd = F.col("std_log2_ratio_a_over_b")
    out = s.agg(F.var_pop("mean_log2_ratio_a_over_b").alias("t"), F.avg(F.when(several, sd * sd)).alias("v"), F.avg(F.when(several, 1.0 / F.col("n_replicates"))).alias("i"))
    return out.select(r6("t").alias("pair_variance"), r6("v").alias("noise_variance"), r6(stats.noise_ceiling(F.col("t"), F.col("v") * F.col("i"), F.lit(1.0))).alias("ceiling"))


@query(
    "run_dispersion",
    "WITH c AS (SELECT l_suppkey AS u, l_linestatus AS r, count(*) AS n FROM lineitem GROUP BY 1, 2), e AS (SELECT n, sum(n) OVER (PARTITION BY u) * sum(n) OVER (PARTITION BY r) / sum(n) OVER () AS e FROM c), s AS (SELECT sum((n - e) * (n - e) / e) AS chi2 FROM e), d AS (SELECT (count(DISTINCT u) - 1) * (count(DISTINCT r) - 1) AS df FROM c) SELECT round(chi2, 4) AS chi2, df, round(chi2 / df, 6) AS dispersion FROM s, d",
)
def run_dispersion(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_linestatus").agg(F.count("*").alias("n"))
    d = share_dispersion(c, unit="l_suppkey", run="l_linestatus", n="n")
    return d.select(F.round("chi2", 4).alias("chi2"), "df", r6("dispersion").alias("dispersion"))


@query("merged_runs", "SELECT l_suppkey, count(*) AS reads, CAST(sum(l_quantity) AS BIGINT) AS bases FROM lineitem GROUP BY 1")
def merged_runs(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    run = lambda k: lines.filter(F.col("l_orderkey") % 2 == k).groupBy("l_suppkey").agg(F.count("*").alias("reads"), F.sum("l_quantity").cast("long").alias("bases"))
    return merged_counts(run(0), run(1), key="l_suppkey", counts=["reads", "bases"])


@query("unordered_equality", "SELECT 'x' AS o_orderstatus, 'y' AS side FROM orders WHERE false")
def unordered_equality(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderstatus")
    return same_rows(o, o.repartition(3))


@query(
    "canonical_matrix",
    "SELECT DISTINCT ON (a, b) a, b, fa, fb FROM (SELECT least(l_suppkey, l_partkey) AS a, greatest(l_suppkey, l_partkey) AS b, CASE WHEN l_suppkey > l_partkey THEN l_partkey * 2 ELSE l_suppkey * 2 END AS fa, CASE WHEN l_suppkey > l_partkey THEN l_suppkey * 2 ELSE l_partkey * 2 END AS fb FROM lineitem)",
)
def canonical_pairs(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b"), (F.col("l_suppkey") * 2).alias("fa"), (F.col("l_partkey") * 2).alias("fb"))
    return canonical_matrix(e, "a", "b", [("fa", "fb")])


# ---- folds and leakage --------------------------------------------------------------------


def _pairs(spark, sf_dir):
    """Supplier pairs that share an order, written once: several steps read them.

    Lines are dealt by order once; both sides of the join keep that partitioning."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").repartition("l_orderkey").distinct()
    a = lines.select("l_orderkey", F.col("l_suppkey").alias("strain_a"))
    b = lines.select("l_orderkey", F.col("l_suppkey").alias("strain_b"))
    return materialize(a.join(b, "l_orderkey").filter("strain_a < strain_b").select("strain_a", "strain_b").distinct(), "pairs")


def _folds(pairs_):
    units = pairs_.select(F.explode(F.array("strain_a", "strain_b")).alias("strain")).distinct()
    return units.select(F.lit(0).alias("rep"), "strain", (F.col("strain") % 5).cast("int").alias("fold"))


FOLDS = """pr AS (SELECT DISTINCT x.l_suppkey AS a, y.l_suppkey AS b FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_suppkey < y.l_suppkey),
f AS (SELECT unnest([0, 1, 2, 3, 4]) AS fold), ro AS (SELECT fold, a, b, CASE WHEN a % 5 = fold AND b % 5 = fold THEN 'test' WHEN a % 5 <> fold AND b % 5 <> fold THEN 'train' END AS role FROM pr, f),
roles AS (SELECT * FROM ro WHERE role IS NOT NULL AND fold IN (SELECT fold FROM ro WHERE role = 'test' GROUP BY 1 HAVING count(*) >= 5))"""


@query("straddle_folds", f"WITH {FOLDS} SELECT CAST(fold AS INTEGER) AS fold, role, count(*) AS n FROM roles GROUP BY 1, 2")
def straddle_folds(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    return folds.strain_folds(p, _folds(p)).groupBy("fold", "role").agg(F.count("*").alias("n"))


def _organism(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("strain"), F.col("s_nationkey").alias("organism"))


@query(
    "purge_anti",
    f"""WITH {FOLDS}, o AS (SELECT s_suppkey AS s, s_nationkey AS g FROM supplier), t AS (SELECT DISTINCT fold, g FROM roles JOIN o ON s = a OR s = b WHERE role = 'test')
SELECT CAST(fold AS INTEGER) AS fold, count(*) AS n_train FROM roles r JOIN o x ON x.s = a JOIN o y ON y.s = b WHERE role = 'train' AND NOT EXISTS (SELECT 1 FROM t WHERE t.fold = r.fold AND t.g IN (x.g, y.g)) GROUP BY 1""",
)
def purge_anti(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    kept = folds.purge(folds.strain_folds(p, _folds(p)), _organism(spark, sf_dir))
    return kept.filter("role = 'train'").groupBy("fold").agg(F.count("*").alias("n_train"))


@query(
    "exposure",
    f"""WITH {FOLDS}, o AS (SELECT s_suppkey AS s, s_nationkey AS g FROM supplier), t AS (SELECT DISTINCT fold, g FROM roles JOIN o ON s = a OR s = b WHERE role = 'train')
SELECT CAST(r.fold AS INTEGER) AS fold, a AS strain_a, b AS strain_b, CAST((EXISTS (SELECT 1 FROM t WHERE t.fold = r.fold AND t.g = x.g))::INT + (EXISTS (SELECT 1 FROM t WHERE t.fold = r.fold AND t.g = y.g))::INT AS BIGINT) AS exposed FROM roles r JOIN o x ON x.s = a JOIN o y ON y.s = b WHERE role = 'test'""",
)
def exposure(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    return folds.exposure(folds.strain_folds(p, _folds(p)), _organism(spark, sf_dir)).select("fold", "strain_a", "strain_b", "exposed")


@query(
    "fold_summary",
    "WITH m AS (SELECT l_returnflag AS arm, l_suppkey % 5 AS fold, l_linenumber AS rep, corr(l_quantity, l_extendedprice) AS rho FROM lineitem GROUP BY 1, 2, 3) SELECT arm, count(DISTINCT fold) AS n_folds, round(avg(rho), 6) AS mean_rho, round(stddev_samp(rho), 6) AS sd_rho FROM m GROUP BY 1",
)
def fold_summary(spark, sf_dir):
    return folds.summarise_folds(_fold_metrics(spark, sf_dir), ["arm"], ["rho"]).select("arm", "n_folds", r6("mean_rho").alias("mean_rho"), r6("sd_rho").alias("sd_rho"))


def _fold_metrics(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(F.col("l_returnflag").alias("arm"), (F.col("l_suppkey") % 5).alias("fold"), F.col("l_linenumber").alias("rep")).agg(F.corr("l_quantity", "l_extendedprice").alias("rho"))


@query(
    "repeat_summary",
    "WITH m AS (SELECT l_returnflag AS arm, l_suppkey % 5 AS fold, l_linenumber AS rep, corr(l_quantity, l_extendedprice) AS rho FROM lineitem GROUP BY 1, 2, 3), p AS (SELECT arm, rep, avg(rho) AS m FROM m GROUP BY 1, 2), q AS (SELECT arm, avg(m) AS a, stddev_samp(m) AS s FROM p GROUP BY 1), d AS (SELECT arm, median(rho) AS md FROM m GROUP BY 1) SELECT arm, round(a, 6) AS mean_rho, round(s, 6) AS sd_rho, round(md, 6) AS median_rho FROM q JOIN d USING (arm)",
)
def repeat_summary(spark, sf_dir):
    s = folds.repeat_summary(_fold_metrics(spark, sf_dir), ["arm"], "rho")
    return s.select("arm", *[r6(c).alias(c) for c in ("mean_rho", "sd_rho", "median_rho")])


@query(
    "paired_folds",
    "WITH m AS (SELECT l_returnflag AS arm, l_suppkey % 5 AS fold, l_linenumber AS rep, corr(l_quantity, l_extendedprice) AS rho FROM lineitem GROUP BY 1, 2, 3), d AS (SELECT x.arm, x.rho - y.rho AS d FROM m x JOIN m y ON x.fold = y.fold AND x.rep = y.rep WHERE y.arm = 'A' AND x.arm <> 'A') SELECT arm, count(*) AS n, round(avg(d), 6) AS mean_delta, round(stddev_samp(d) / sqrt(count(*)), 6) AS se_delta, round(avg(CASE WHEN d > 0 THEN 1.0 ELSE 0.0 END), 6) AS share_better FROM d GROUP BY 1",
)
def paired_folds(spark, sf_dir):
    d = folds.paired_deltas(_fold_metrics(spark, sf_dir), arm="arm", baseline="A", keys=["fold", "rep"], metric="rho")
    return d.select("arm", "n", *[r6(c).alias(c) for c in ("mean_delta", "se_delta", "share_better")])


@query("label_subsets", f"WITH {SUPPLIER_WELLS} SELECT strain_a, strain_b, strain_a % 9 = 0 OR strain_b % 9 = 0 AS any_wrong, NOT (strain_a % 9 = 0 OR strain_b % 9 = 0) AS both_ok FROM spairs")
def label_subsets(spark, sf_dir):
    p = scoring.replicate_stability(supplier_wells(spark, sf_dir)).select("strain_a", "strain_b")
    wrong = table(spark, sf_dir, "supplier").filter("s_suppkey % 9 = 0").select(F.col("s_suppkey").alias("strain"))
    return folds.label_subsets(p, wrong).select("strain_a", "strain_b", "any_wrong", "both_ok")


@query(
    "mono_contrast",
    "WITH w AS (SELECT l_partkey, median(l_extendedprice) FILTER (l_quantity <= 10) AS low, median(l_extendedprice) FILTER (l_quantity >= 40) AS high FROM lineitem GROUP BY 1) SELECT count(*) AS n, round(median(log2(high / low)), 6) AS median_log2_ratio FROM w WHERE low IS NOT NULL AND high IS NOT NULL",
)
def mono_contrast(spark, sf_dir):
    q, x = F.col("l_quantity"), F.col("l_extendedprice")
    w = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.median(F.when(q <= 10, x)).alias("low"), F.median(F.when(q >= 40, x)).alias("high")).dropna()
    return w.agg(F.count("*").alias("n"), r6(F.median(F.log2(F.col("high") / F.col("low")))).alias("median_log2_ratio"))


@query(
    "purge_control",
    "WITH m AS (SELECT l_returnflag AS arm, l_suppkey % 5 AS fold, avg(l_discount) AS r FROM lineitem GROUP BY 1, 2) SELECT round(avg(a - n), 6) AS delta_first, round(avg(n - r2), 6) AS delta_second FROM (SELECT fold, max(r) FILTER (arm = 'A') AS a, max(r) FILTER (arm = 'N') AS n, max(r) FILTER (arm = 'R') AS r2 FROM m GROUP BY 1)",
)
def purge_control(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("arm"), (F.col("l_suppkey") % 5).alias("fold")).agg(F.avg("l_discount").alias("r"))
    wide = m.groupBy("fold").pivot("arm", ["A", "N", "R"]).agg(F.first("r"))
    return wide.agg(r6(F.avg(F.col("A") - F.col("N"))).alias("delta_first"), r6(F.avg(F.col("N") - F.col("R"))).alias("delta_second"))


# ---- seeded resampling: draws are hashes that SQL computes as well ------------------------


@query(
    "pseudo_perm",
    f"""WITH {SUPPLIER_WELLS}, edges AS (SELECT strain_a, strain_b FROM spairs WHERE mra <> 0.5), s AS (SELECT r, avg(CASE WHEN {uniform_sql(0, "r", "strain_a", "strain_b")} < 0.5 THEN 1.0 ELSE 0.0 END) AS share FROM edges, range(1, 201) t(r) GROUP BY 1)
SELECT round((count(*) FILTER (share >= 0.52) + 1) / (count(*) + 1), 6) AS p_value, round(avg(share), 6) AS null_mean, round(stddev_pop(share), 6) AS null_sd, count(*) AS n FROM s""",
)
def pseudo_perm(spark, sf_dir):
    edges = scoring.win_edges(scoring.replicate_stability(supplier_wells(spark, sf_dir)), F.col("mean_relative_abundance_a"))
    out = stats.permutation_p(stats.coin_shares(edges, 200), "share", 0.52)
    return out.select(*[r6(c).alias(c) for c in ("p_value", "null_mean", "null_sd")], "n")


POISSON_1 = [float(x) for x in np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])]


@query(
    "bootstrap_ci",
    f"""WITH {SUPPLIER_WELLS}, u AS (SELECT l_orderkey, r, {uniform_sql(0, "r", "l_orderkey")} AS u FROM (SELECT DISTINCT l_orderkey FROM swells), range(1, 101) t(r)),
w AS (SELECT l_orderkey, r, list_sum(list_transform({POISSON_1}, lambda c: CASE WHEN u >= c THEN 1 ELSE 0 END)) AS w FROM u),
m AS (SELECT strain_a, r, sum(lr * w) / sum(w) AS m FROM swells JOIN w USING (l_orderkey) WHERE w > 0 GROUP BY 1, 2) SELECT strain_a, round(quantile_cont(m, 0.025), 6) AS ci_low, round(quantile_cont(m, 0.975), 6) AS ci_high FROM m GROUP BY 1""",
)
def bootstrap_ci(spark, sf_dir):
    wells = supplier_wells(spark, sf_dir).select("strain_a", F.col("l_orderkey").alias("well"), F.col("log2_ratio_a_over_b").alias("x"))
    means = stats.bootstrap_means(wells, unit="well", value="x", by="strain_a", replicates=100)
    return stats.percentile_interval(means, "m", ["strain_a"]).select("strain_a", r6("ci_low").alias("ci_low"), r6("ci_high").alias("ci_high"))


@query(
    "permuted_labels",
    f"""WITH e AS (SELECT CAST(r AS INTEGER) AS replicate, s_suppkey AS strain, s_nationkey AS genome FROM supplier, range(1, 6) t(r)), l AS (SELECT replicate, genome, row_number() OVER (PARTITION BY replicate ORDER BY strain) AS n FROM e),
d AS (SELECT replicate, strain, row_number() OVER (PARTITION BY replicate ORDER BY {uniform_sql(0, "replicate", "strain")}, strain) AS n FROM e) SELECT replicate, strain, genome FROM d JOIN l USING (replicate, n)""",
)
def permuted_labels(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("strain"), F.col("s_nationkey").alias("genome"))
    return stats.permuted_labels(s, key="strain", label="genome", replicates=5)


@query(
    "unit_folds",
    f"WITH e AS (SELECT CAST(r AS INTEGER) AS rep, s_suppkey AS strain FROM supplier, range(3) t(r)) SELECT rep, strain, CAST((row_number() OVER (PARTITION BY rep ORDER BY {uniform_sql(0, 'rep', 'strain')}, strain) - 1) % 5 AS INTEGER) AS fold FROM e",
)
def unit_folds(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("strain"))
    return folds.unit_folds(s, "strain", 5, repeats=3)


@query("pair_folds", f"WITH {FOLDS} SELECT a AS strain_a, b AS strain_b, CAST(floor({uniform_sql(0, 'a', 'b')} * 5) AS INTEGER) AS fold FROM pr")
def pair_folds(spark, sf_dir):
    return folds.pair_folds(_pairs(spark, sf_dir), 5)


@query(
    "replicate_direction",
    f"""WITH {SUPPLIER_WELLS}, c AS (SELECT p.strain_a, p.lr AS x, q.lr AS y, {uniform_sql(0, "p.l_orderkey", "q.l_orderkey")} < 0.5 AS flip FROM swells p JOIN swells q ON p.strain_a = q.strain_a AND p.strain_b = q.strain_b AND p.l_orderkey < q.l_orderkey),
d AS (SELECT strain_a, CASE WHEN flip THEN y ELSE x END AS a, CASE WHEN flip THEN x ELSE y END AS b FROM c)
SELECT strain_a, count(*) AS n, round(1 - sum((b - a) * (b - a)) / nullif(var_pop(b) * count(*), 0), 6) AS r2_identity, round(CASE WHEN var_pop(a) > 0 AND var_pop(b) > 0 THEN corr(a, b) * corr(a, b) END, 6) AS r2_linear, round(CASE WHEN var_pop(a) > 0 THEN regr_slope(b, a) END, 6) AS slope, round(avg(CASE WHEN (a > 0) = (b > 0) THEN 1.0 ELSE 0.0 END), 6) AS winner_agreement FROM d GROUP BY 1""",
)
def replicate_direction(spark, sf_dir):
    couples = pairs.within_pair_replicates(supplier_wells(spark, sf_dir), id_col="l_orderkey")
    m = stats.identity_metrics(couples, "x", "y", ["strain_a"])
    return m.select("strain_a", "n", *[r6(c).alias(c) for c in ("r2_identity", "r2_linear", "slope", "winner_agreement")])
