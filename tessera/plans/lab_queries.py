"""Plates, genomes, clusters, models and designs on the driver tables."""

from __future__ import annotations


import numpy as np
from pyspark.sql import functions as F

from tessera.functions.draws import uniform_sql
from tessera.operators import communities, design, features, folds, genomes, models, scoring, wells
from tessera.operators import plate_controls as P
from tessera.storage import materialize

from .registry import query
from .tables import SUPPLIER_WELLS, r6, supplier_wells, table


def _cells(spark, sf_dir):
    """Part sizes and prices as plates of 16 x 24 wells."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select((F.floor(k / 384)).cast("int").alias("plate"), (F.floor(k % 384 / 24)).cast("int").alias("row"), (k % 24).cast("int").alias("col"), "p_size", "p_brand", F.col("p_retailprice").alias("od"))


CELLS = "cells AS (SELECT CAST(p_partkey // 384 AS INTEGER) AS plate, CAST(p_partkey % 384 // 24 AS INTEGER) AS row, CAST(p_partkey % 24 AS INTEGER) AS col, p_size, p_brand, p_retailprice AS od FROM part)"


@query(
    "neighbour_pairs",
    f"WITH {CELLS} SELECT a.plate, count(*) AS n_pairs, count(*) FILTER (a.p_brand = b.p_brand) AS n_same FROM cells a JOIN cells b ON a.plate = b.plate AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 AND (a.row < b.row OR (a.row = b.row AND a.col < b.col)) GROUP BY 1",
)
def neighbour_pairs(spark, sf_dir):
    pairs = P.neighbour_pairs(_cells(spark, sf_dir), keep=("p_brand",))
    return pairs.groupBy("plate").agg(F.count("*").alias("n_pairs"), F.count_if(F.col("p_brand_1") == F.col("p_brand_2")).alias("n_same"))


@query(
    "offset_control",
    f"WITH {CELLS}, o AS (SELECT unnest([0, 0, 1, -1]) AS d_row, unnest([0, 1, 0, 2]) AS d_col) SELECT CAST(d_row AS INTEGER) AS d_row, CAST(d_col AS INTEGER) AS d_col, count(*) AS n, round(corr(a.od, b.od), 6) AS r FROM cells a JOIN o ON true JOIN cells b ON a.plate = b.plate AND b.row = a.row + d_row AND b.col = a.col + d_col GROUP BY 1, 2",
)
def offset_control(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    return P.offset_control(cells, cells, "od", [(0, 0), (0, 1), (1, 0), (-1, 2)]).select("d_row", "d_col", "n", r6("r").alias("r"))


@query(
    "univariate_screen",
    "WITH x AS (SELECT l_extendedprice / 1000 - 40 AS y, l_quantity, l_discount, l_tax FROM lineitem), u AS (SELECT 'l_quantity' AS feature, l_quantity AS x, y FROM x UNION ALL SELECT 'l_discount', l_discount, y FROM x UNION ALL SELECT 'l_tax', l_tax, y FROM x) SELECT feature, count(*) AS n, round(corr(x, y), 6) AS pearson_r, round(avg(CASE WHEN sign(x) = sign(y) THEN 1.0 ELSE 0.0 END) FILTER (abs(y) > 1), 6) AS sign_accuracy FROM u GROUP BY 1",
)
def univariate_screen(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").withColumn("y", F.col("l_extendedprice") / 1000 - 40)
    s = P.univariate_screen(x, ["l_quantity", "l_discount", "l_tax"], "y")
    return s.select("feature", "n", r6("pearson_r").alias("pearson_r"), r6("sign_accuracy").alias("sign_accuracy"))


@query("transform_support", f"WITH {CELLS} SELECT plate, 'identity' AS transform, count(*) AS n, count(*) AS supported FROM cells WHERE row BETWEEN 2 AND 13 AND col BETWEEN 2 AND 21 GROUP BY 1")
def transform_support(spark, sf_dir):
    cells = _cells(spark, sf_dir).select("plate", "row", "col", F.col("p_brand").alias("label"))
    return P.transform_support(cells, cells, P.candidate_transforms(spark), by=["plate"]).filter("transform = 'identity'").select("plate", "transform", "n", "supported")


@query(
    "adjacency_enrichment",
    f"""WITH {CELLS}, c AS (SELECT *, concat_ws(':', plate, row, col) AS id FROM cells), e AS (SELECT r, id, p_brand FROM c, range(1, 5001) t(r)), l AS (SELECT r, p_brand, row_number() OVER (PARTITION BY r ORDER BY id) AS n FROM e),
d AS (SELECT r, id, row_number() OVER (PARTITION BY r ORDER BY {uniform_sql(0, "r", "id")}, id) AS n FROM e), x AS (SELECT r, id, p_brand FROM d JOIN l USING (r, n) UNION ALL SELECT 0, id, p_brand FROM c),
near AS (SELECT a.id AS i, b.id AS j FROM c a JOIN c b ON a.plate = b.plate AND abs(a.row - b.row) <= 2 AND abs(a.col - b.col) <= 2 AND (a.row < b.row OR (a.row = b.row AND a.col < b.col))),
k AS (SELECT a.r, count(*) FILTER (a.p_brand = b.p_brand) AS n FROM near JOIN x a ON a.id = i JOIN x b ON b.id = j AND b.r = a.r GROUP BY 1), s AS (SELECT max(n) FILTER (r = 0) AS o, avg(n) FILTER (r > 0) AS m, stddev_pop(n) FILTER (r > 0) AS d FROM k)
SELECT o AS observed, round(m, 6) AS null_mean, round(d, 6) AS null_sd, round((o - m) / nullif(d, 0), 6) AS z, round((SELECT count(*) FILTER (n >= o) / count(*) FROM k WHERE r > 0), 6) AS p_value FROM s""",
)
def adjacency_enrichment(spark, sf_dir):
    out = P.adjacency_enrichment(_cells(spark, sf_dir), "p_brand")
    return out.select("observed", *[r6(c).alias(c) for c in ("null_mean", "null_sd", "z", "p_value")])


TRANSFORMS = """grid AS (SELECT CAST(i // 24 AS INTEGER) AS row, CAST(i % 24 AS INTEGER) AS col FROM range(384) t(i)), shifts AS (SELECT a, b FROM range(-2, 3) s(a), range(-2, 3) t(b) WHERE (a, b) <> (0, 0)),
named AS (SELECT 'identity' AS transform, row, col, row AS to_row, col AS to_col FROM grid UNION ALL SELECT 'flip_rows', row, col, 15 - row, col FROM grid UNION ALL SELECT 'flip_cols', row, col, row, 23 - col FROM grid UNION ALL SELECT 'half_turn', row, col, 15 - row, 23 - col FROM grid
  UNION ALL SELECT 'shift_' || a || '_' || b, row, col, row + a, col + b FROM grid, shifts UNION ALL SELECT 'swap_odd_rows', row, col, row + CASE WHEN row % 2 = 0 THEN 1 ELSE -1 END, col FROM grid UNION ALL SELECT 'swap_odd_cols', row, col, row, col + CASE WHEN col % 2 = 0 THEN 1 ELSE -1 END FROM grid),
inside AS (SELECT * FROM named WHERE to_row BETWEEN 0 AND 15 AND to_col BETWEEN 0 AND 23), moves AS (SELECT * FROM inside WHERE (row, col) IN (SELECT (row, col) FROM inside GROUP BY row, col HAVING count(*) = (SELECT count(DISTINCT transform) FROM inside)))"""


@query(
    "transform_search",
    f"""WITH {CELLS}, {TRANSFORMS}, e AS (SELECT r, plate, row, col, concat_ws(':', row, col) AS id, p_brand FROM cells, range(1, 21) t(r)), l AS (SELECT r, plate, p_brand, row_number() OVER (PARTITION BY r, plate ORDER BY id) AS n FROM e),
d AS (SELECT r, plate, row, col, row_number() OVER (PARTITION BY r, plate ORDER BY {uniform_sql(0, "r", "id")}, id) AS n FROM e), x AS (SELECT r, plate, row, col, p_brand FROM d JOIN l USING (r, plate, n) UNION ALL SELECT 0, plate, row, col, p_brand FROM cells),
k AS (SELECT r, x.plate, transform, count(*) AS n, count(*) FILTER (x.p_brand = c.p_brand) AS k FROM moves m JOIN x USING (row, col) JOIN cells c ON c.plate = x.plate AND c.row = to_row AND c.col = to_col GROUP BY 1, 2, 3),
best AS (SELECT r, plate, max(k) AS k FROM k WHERE r > 0 GROUP BY 1, 2)
SELECT plate, transform, n, k AS supported, round(k / n, 6) AS share, round(((SELECT count(*) FROM best b WHERE b.plate = o.plate AND b.k >= o.k) + 1) / ((SELECT count(*) FROM best b WHERE b.plate = o.plate) + 1), 6) AS family_p FROM k o WHERE r = 0""",
)
def transform_search(spark, sf_dir):
    cells = _cells(spark, sf_dir).select("plate", "row", "col", F.col("p_brand").alias("label"))
    out = P.transform_search(cells, cells, P.candidate_transforms(spark), replicates=20, by=["plate"])
    return out.select("plate", "transform", "n", "supported", r6("share").alias("share"), r6("family_p").alias("family_p"))


@query(
    "locality",
    f"""WITH {CELLS}, wells AS (SELECT row, col, row_number() OVER (ORDER BY row, col) - 1 AS w FROM (SELECT DISTINCT row, col FROM cells)), v AS (SELECT plate, row, col, p_brand, concat_ws(':', plate, row, col, p_brand) AS e FROM cells WHERE p_size = 7),
a AS (SELECT plate, p_brand, e, draw, CAST(floor({uniform_sql(0, "draw", "e")} * (SELECT count(*) FROM wells)) AS BIGINT) AS w FROM v, range(1, 51) t(draw)), x AS (SELECT plate, p_brand, e, draw, row, col FROM a JOIN wells USING (w) UNION ALL SELECT plate, p_brand, e, 0, row, col FROM v),
n AS (SELECT draw, e, min(sqrt((x.row - h.row) ** 2 + (x.col - h.col) ** 2)) AS d FROM x JOIN cells h ON h.p_size <> 7 AND h.plate = x.plate AND h.p_brand = x.p_brand GROUP BY 1, 2), m AS (SELECT draw, avg(d) AS d FROM n GROUP BY 1), o AS (SELECT max(d) FILTER (draw = 0) AS o FROM m)
SELECT round(any_value(o), 6) AS observed, round(avg(d), 6) AS null_mean, round(count(*) FILTER (d <= o + 1e-12) / count(*), 6) AS p_value FROM m, o WHERE draw > 0""",
)
def locality(spark, sf_dir):
    cells = _cells(spark, sf_dir).select("plate", "row", "col", F.col("p_brand").alias("label"), "p_size")
    out = P.locality(cells.filter("p_size = 7").drop("p_size"), cells.filter("p_size <> 7").drop("p_size"), cells.select("row", "col"), draws=50)
    return out.select(*[r6(c).alias(c) for c in ("observed", "null_mean", "p_value")])


@query(
    "duplicate_isolates",
    "WITH w AS (SELECT s_suppkey AS well, s_nationkey AS isolate, CASE WHEN s_acctbal < 0 THEN NULL ELSE s_suppkey % 3 END AS c FROM supplier) SELECT a.isolate, a.well AS a, b.well AS b, CASE WHEN a.c IS NULL OR b.c IS NULL THEN 'unverified' WHEN a.c = b.c THEN 'holds' ELSE 'other' END AS state FROM w a JOIN w b ON a.isolate = b.isolate AND a.well < b.well",
)
def duplicate_isolates(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("well"), F.col("s_nationkey").alias("isolate"), F.when(F.col("s_acctbal") >= 0, F.col("s_suppkey") % 3).alias("clone_cluster"))
    return genomes.duplicate_isolates(s)


@query(
    "genome_verdicts",
    """WITH h AS (SELECT DISTINCT l_suppkey AS strain, l_partkey % 100 + 1 AS genome, (l_suppkey * 7 + l_partkey % 100 * 13) % 50 / 2000.0 AS dist FROM lineitem), c AS (SELECT *, CASE WHEN dist <= 0.002 THEN 'match' WHEN dist >= 0.01 THEN 'mismatch' ELSE 'ambiguous' END AS call FROM h),
o AS (SELECT strain, min(dist) AS d FROM c WHERE strain = genome GROUP BY 1), k AS (SELECT strain, count(DISTINCT genome) AS n FROM c WHERE call = 'match' GROUP BY 1), v AS (SELECT DISTINCT strain FROM c WHERE call = 'match' AND strain <> genome AND strain % 20 = genome % 20)
SELECT s_suppkey AS strain, CAST(coalesce(n, 0) AS INTEGER) AS n_carriers, CASE WHEN d <= 0.002 THEN 'verified' WHEN v.strain IS NOT NULL THEN 'vouched' WHEN d >= 0.01 AND coalesce(n, 0) > 0 THEN 'wrong_genome' WHEN d >= 0.01 THEN 'contradicted' WHEN d IS NOT NULL THEN 'ambiguous' ELSE 'no_genome' END AS status
FROM supplier LEFT JOIN o ON o.strain = s_suppkey LEFT JOIN k ON k.strain = s_suppkey LEFT JOIN v ON v.strain = s_suppkey""",
)
def genome_verdicts(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("strain"))
    g = (F.col("l_partkey") % 100 + 1).alias("genome")
    h = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("strain"), g, ((F.col("l_suppkey") * 7 + F.col("l_partkey") % 100 * 13) % 50 / 2000.0).alias("dist")).distinct()
    clones = s.select(F.col("strain").alias("well"), (F.col("strain") % 20).alias("clone_cluster"))
    out = genomes.genome_verdicts(s, h, clones)
    return out.select("strain", F.size("carriers").alias("n_carriers"), "status")


@query(
    "eligible_units",
    "WITH x AS (SELECT c_custkey AS strain, c_nationkey AS unit, CASE WHEN c_acctbal > 5000 THEN 0 ELSE 1 END AS t, c_acctbal AS c FROM customer) SELECT unit, arg_min(strain, (t, -c, strain)) AS strain, CAST(count(*) - 1 AS INTEGER) AS n_mates FROM x GROUP BY 1",
)
def eligible_units(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("strain"), F.col("c_nationkey").alias("unit"), F.when(F.col("c_acctbal") > 5000, "high").otherwise("medium").alias("tier"), F.col("c_acctbal").alias("competing"))
    return genomes.eligible_units(c).select("unit", "strain", F.size("mates").alias("n_mates"))


@query(
    "races",
    "WITH r AS (SELECT n_name AS strain, substr(n_name, 1, length(n_name) - 1) || c AS seq FROM nation CROSS JOIN (SELECT unnest(['', 'A', 'NA']) AS c)), d AS (SELECT strain, m.n_name AS rival, levenshtein(seq, m.n_name) - levenshtein(seq, strain) AS d FROM r JOIN nation m ON m.n_name <> strain AND levenshtein(m.n_name, strain) <= 4) SELECT strain, rival, count(*) AS n, count(*) FILTER (d > 0) AS correct, count(*) FILTER (d = 0) AS tied, count(*) FILTER (d < 0) AS wrong FROM d GROUP BY 1, 2",
)
def races(spark, sf_dir):
    from tessera.operators.identity import distances

    from .identity_queries import nation_names

    refs = nation_names(spark, sf_dir)
    tails = F.explode(F.array(*map(F.lit, ("", "A", "NA")))).alias("c")
    reads = refs.select("name", tails).select(F.col("name").alias("strain"), F.concat(F.expr("substring(name, 1, length(name) - 1)"), F.col("c")).alias("seq"))
    near = distances(refs, refs).filter("bp <= 4 AND query <> ref").select(F.col("query").alias("strain"), F.col("ref").alias("rival"))
    return genomes.races(reads, refs, near)


@query(
    "kmer_candidates",
    "WITH m AS (SELECT DISTINCT p_name AS name, substr(p_name, i, 4) AS mer FROM part, generate_series(1, 30) t(i) WHERE i <= greatest(length(p_name) - 3, 1)), n AS (SELECT count(DISTINCT p_name) AS n FROM part), c AS (SELECT mer FROM m GROUP BY 1 HAVING count(*) > (SELECT greatest(1, n // 2) FROM n)), k AS (SELECT a.name AS read_id, b.name AS ref, count(*) AS shared FROM m a JOIN m b USING (mer) WHERE mer NOT IN (SELECT mer FROM c) GROUP BY 1, 2) SELECT read_id, ref, shared FROM k QUALIFY row_number() OVER (PARTITION BY read_id ORDER BY shared DESC, ref) <= 3",
)
def kmer_candidates(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    return genomes.kmer_candidates(names.select(F.col("name").alias("read_id"), F.col("name").alias("seq")), names.select("name", F.col("name").alias("seq")), k=4, top=3)


@query(
    "cv_groups",
    """WITH RECURSIVE w AS (SELECT CAST(s_suppkey AS VARCHAR) AS w, CAST(s_nationkey AS VARCHAR) AS u, CASE WHEN s_suppkey % 11 = 0 THEN CAST(s_suppkey % 25 AS VARCHAR) END AS v FROM supplier),
e AS (SELECT 'w:' || w AS a, 'u:' || u AS b FROM w UNION SELECT 'w:' || w, 'u:' || v FROM w WHERE v IS NOT NULL), both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT a AS x, a AS r FROM both_ways UNION SELECT reach.x, b FROM reach JOIN both_ways ON reach.r = both_ways.a) SELECT substr(x, 3) AS well, min(r) AS cv_group FROM reach WHERE x LIKE 'w:%' GROUP BY 1""",
)
def cv_groups(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("well"), F.col("s_nationkey").alias("genome_unit"), F.when(F.col("s_suppkey") % 11 == 0, F.col("s_suppkey") % 25).alias("is_of"))
    return genomes.cv_groups(s)


@query("clone_features", "SELECT p_brand AS strain, count(DISTINCT p_type) AS n_features FROM part GROUP BY 1")
def clone_features(spark, sf_dir):
    f = table(spark, sf_dir, "part").select(F.col("p_brand").alias("strain"), F.col("p_type").alias("feature"))
    return features.present(f).groupBy("strain").agg(F.count("*").alias("n_features"))


@query(
    "greedy_seed",
    """WITH o AS (SELECT p_brand AS sample_id, list({'seqs': [p_name], 'seeds': [p_name], 'own': [1]} ORDER BY p_partkey) AS l FROM part GROUP BY 1),
g AS (SELECT sample_id, list_reduce(l, lambda a, x: CASE WHEN list_contains(a.seqs, x.seqs[1]) THEN {'seqs': list_concat(a.seqs, x.seqs), 'seeds': a.seeds, 'own': list_append(a.own, a.own[list_position(a.seqs, x.seqs[1])])}
  WHEN list_min(list_transform(a.seeds, lambda s: levenshtein(s, x.seqs[1]) / greatest(length(s), length(x.seqs[1])))) <= 0.35 THEN {'seqs': list_concat(a.seqs, x.seqs), 'seeds': a.seeds, 'own': list_append(a.own, list_position(list_transform(a.seeds, lambda s: levenshtein(s, x.seqs[1]) / greatest(length(s), length(x.seqs[1]))), list_min(list_transform(a.seeds, lambda s: levenshtein(s, x.seqs[1]) / greatest(length(s), length(x.seqs[1]))))))}
  ELSE {'seqs': list_concat(a.seqs, x.seqs), 'seeds': list_concat(a.seeds, x.seqs), 'own': list_append(a.own, len(a.seeds) + 1)} END) AS g FROM o),
r AS (SELECT sample_id, unnest(g.seqs) AS seq, unnest(g.own) AS own, generate_subscripts(g.seqs, 1) AS i FROM g), c AS (SELECT sample_id, own, count(*) AS n FROM r GROUP BY 1, 2),
f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY sample_id, own ORDER BY i) <= 25), d AS (SELECT x.sample_id, x.own, x.i, any_value(x.seq) AS seq, sum(levenshtein(x.seq, y.seq)) AS d FROM f x JOIN f y ON x.sample_id = y.sample_id AND x.own = y.own GROUP BY 1, 2, 3),
m AS (SELECT sample_id, own, arg_min(seq, (d, i)) AS seq FROM d GROUP BY 1, 2), t AS (SELECT sample_id, sum(n) AS n_reads, list(n ORDER BY n DESC, own) AS sizes FROM c GROUP BY 1), s AS (SELECT c.sample_id, list(m.seq ORDER BY c.n DESC, c.own) AS reps FROM c JOIN m USING (sample_id, own) JOIN t USING (sample_id) WHERE c.n >= greatest(3, 0.1 * n_reads) GROUP BY 1)
SELECT t.sample_id, CAST(n_reads AS INTEGER) AS n_reads, CAST(coalesce(len(reps), 0) AS INTEGER) AS n_strains, CAST(len(sizes) AS INTEGER) AS n_raw_clusters, array_to_string(sizes[1:6], ',') AS cluster_sizes, round(sizes[1] / n_reads, 6) AS top_frac, round(coalesce(sizes[2], 0) / n_reads, 6) AS minority_frac, coalesce(array_to_string(reps, ','), '') AS representatives FROM t LEFT JOIN s USING (sample_id)""",
)
def greedy_seed(spark, sf_dir):
    reads = table(spark, sf_dir, "part").select(F.col("p_brand").alias("sample_id"), F.col("p_partkey").alias("read_id"), F.col("p_name").alias("seq"))
    out = wells.cluster_wells(reads, 0.35)
    return out.select("sample_id", "n_reads", "n_strains", "n_raw_clusters", F.array_join(F.col("cluster_sizes").cast("array<string>"), ",").alias("cluster_sizes"), r6("top_frac").alias("top_frac"), r6("minority_frac").alias("minority_frac"), F.array_join("representatives", ",").alias("representatives"))


@query("consensus_vote")
def consensus_vote(spark, sf_dir):
    seq = F.concat(F.col("p_name"), F.when(F.col("p_partkey") % 9 == 0, "x").otherwise(""))
    reps = table(spark, sf_dir, "part").select(F.col("p_brand").alias("strain"), seq.alias("seq"), F.col("p_partkey").cast("string").alias("sample_id"), F.when(F.col("p_size") < 10, "mono").otherwise("pair").alias("well_type"), (F.col("p_partkey") % 8).alias("plate"))
    return wells.strain_consensus(reps).drop("consensus")


@query(
    "tiled_hits",
    """WITH h AS (SELECT l_partkey, CAST(l_quantity AS BIGINT) AS s, CAST(l_quantity + l_linenumber * 3 AS BIGINT) AS e, l_extendedprice AS score FROM lineitem), o AS (SELECT l_partkey, list([{'s': s, 'e': e}] ORDER BY score DESC, s, e) AS l FROM h GROUP BY 1),
k AS (SELECT l_partkey, list_reduce(l, lambda a, x: CASE WHEN len(list_filter(a, lambda y: x[1].e > y.s AND x[1].s < y.e)) = 0 THEN list_concat(a, x) ELSE a END) AS kept FROM o)
SELECT l_partkey, CAST(len(kept) AS INTEGER) AS n_hits, CAST(list_sum(list_transform(kept, lambda y: y.e - y.s)) AS BIGINT) AS covered FROM k""",
)
def tiled_hits(spark, sf_dir):
    hits = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_quantity").cast("long").alias("start"), (F.col("l_quantity") + F.col("l_linenumber") * 3).cast("long").alias("end"), F.col("l_extendedprice").alias("score"))
    return wells.tiled_hits(hits, ["l_partkey"])


def _pair_stats(spark, sf_dir):
    return scoring.replicate_stability(supplier_wells(spark, sf_dir))


#: Maximum likelihood strengths by minorisation: p = wins / sum(games / (p + p of the rival)), until nothing moves.
BRADLEY_TERRY = f"""{SUPPLIER_WELLS}, pc AS (SELECT strain_a AS a, strain_b AS b, sum(n1) AS w, sum(n1) + sum(n2) AS n FROM swells GROUP BY 1, 2 HAVING sum(n1) + sum(n2) > 0), g AS (SELECT a AS i, b AS j, w, n FROM pc UNION ALL SELECT b, a, n - w, n FROM pc), wins AS (SELECT i, sum(w) AS w FROM g GROUP BY 1),
fit AS (SELECT 0 AS k, i, 1.0::DOUBLE AS p FROM wins UNION ALL (SELECT k + 1, i, p / exp(avg(ln(p)) OVER ()) FROM (SELECT x.k AS k, x.i AS i, any_value(wins.w) / sum(g.n / (x.p + y.p)) AS p FROM fit x JOIN g ON g.i = x.i JOIN fit y ON y.i = g.j JOIN wins ON wins.i = x.i WHERE x.k < 120 GROUP BY x.k, x.i))),
bt AS (SELECT i AS strain, ln(p) - first_value(ln(p)) OVER (ORDER BY i) AS s FROM fit WHERE k = 120), q AS (SELECT w, n, 1 / (1 + exp(y.s - x.s)) AS p, sum(w) OVER () / sum(n) OVER () AS p0 FROM pc JOIN bt x ON x.strain = a JOIN bt y ON y.strain = b),
dev AS (SELECT 2 * sum(CASE WHEN w > 0 THEN w * ln(w / (n * p)) ELSE 0 END + CASE WHEN n > w THEN (n - w) * ln((n - w) / (n * (1 - p))) ELSE 0 END) AS d, 2 * sum(CASE WHEN w > 0 THEN w * ln(w / (n * p0)) ELSE 0 END + CASE WHEN n > w THEN (n - w) * ln((n - w) / (n * (1 - p0))) ELSE 0 END) AS d0, count(*) - ((SELECT count(*) FROM bt) - 1) AS df FROM q)"""


@query(
    "bt_glm",
    f"WITH RECURSIVE {BRADLEY_TERRY} SELECT strain, round(s, 4) AS bt_strength, CAST(row_number() OVER (ORDER BY s DESC, strain) AS INTEGER) AS bt_rank, round(1 - d / d0, 4) AS pseudo_r2, round(d, 2) AS deviance, round(d0, 2) AS null_deviance, CAST(df AS INTEGER) AS df_resid FROM bt, dev",
)
def bt_glm(spark, sf_dir):
    fit = models.fit_bradley_terry(scoring.pooled_counts(supplier_wells(spark, sf_dir)), errors=False)
    return fit.select("strain", F.round("bt_strength", 4).alias("bt_strength"), "bt_rank", F.round("pseudo_r2", 4).alias("pseudo_r2"), F.round("deviance", 2).alias("deviance"), F.round("null_deviance", 2).alias("null_deviance"), "df_resid")


@query(
    "bt_goodness_of_fit",
    f"WITH RECURSIVE {BRADLEY_TERRY} SELECT (SELECT count(*) FROM bt) AS n_strains, round(d0 - d, 2) AS lr_stat, CAST(df AS INTEGER) AS df_resid, round(d / df, 4) AS dispersion_ratio FROM dev",
)
def bt_goodness_of_fit(spark, sf_dir):
    fit = models.goodness_of_fit(models.fit_bradley_terry(scoring.pooled_counts(supplier_wells(spark, sf_dir)), errors=False))
    return fit.select("n_strains", F.round("lr_stat", 2).alias("lr_stat"), "df_resid", F.round("dispersion_ratio", 4).alias("dispersion_ratio"))


@query("group_cv")
def group_cv(spark, sf_dir):
    import pandas as pd

    pairs = materialize(_pair_stats(spark, sf_dir).select("strain_a", "strain_b", "mean_log2_ratio_a_over_b"), "pairs")
    units = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("strain"))
    bits = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").pivot("l_linenumber", list(range(1, 8))).agg(F.avg("l_quantity")).toPandas().set_index("l_suppkey").sort_index()
    frame = pd.DataFrame(bits.fillna(0.0).to_numpy(), index=bits.index)
    roles = folds.strain_folds(pairs, folds.unit_folds(units, "strain", 2))
    chosen = {k: models.MODELS[k] for k in ("zero", "strength_observed", "ridge", "two_stage_ridge")}
    return models.fold_scores(materialize(models.cross_validate(roles, pairs, frame, target="mean_log2_ratio_a_over_b", models=chosen), "predictions"))


@query("max_separable_set")
def max_separable_set(spark, sf_dir):
    from .identity_queries import found

    d = {frozenset((r["query"], r["ref"])): r["bp"] for r in found(spark, sf_dir).collect()}  # names of parts: a dimension of 64
    names = sorted({x for k in d for x in k})
    best = design.max_separable(names, lambda a, b: d[frozenset((a, b))], 6)
    return spark.createDataFrame([(x,) for x in best], "name string")


@query("community_design")
def community_design(spark, sf_dir):
    from .identity_queries import found

    d = {frozenset((r["query"], r["ref"])): float(r["bp"]) for r in found(spark, sf_dir).collect() if r["query"] != r["ref"]}
    names = sorted({x.replace(" ", "_") for k in d for x in k})
    d = {frozenset(x.replace(" ", "_") for x in k): v for k, v in d.items()}
    c = communities.Pool.of(names, d, np.random.default_rng(0))
    c.over_distances({2: 10, 4: 6}, 6, "stratified")
    c.with_removals(5, 1, 6)
    return spark.createDataFrame([(r["community_id"], r["members"], r["size"], r["module"], r["min_sep_bp"], r["mpd_bp"]) for r in c.table()], "community_id string, members string, size int, module string, min_sep_bp double, mpd_bp double")


@query("barcode_assignment")
def barcode_assignment(spark, sf_dir):
    plate = design.wells_table(spark, inner=True).select(F.lit(1).alias("plate"), "well")
    return design.assign_barcodes(plate, design.barcode_combinations(spark, 24))


@query("inner_wells", "SELECT CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col, chr(CAST(65 + r AS INTEGER)) || CAST(c AS VARCHAR) AS well FROM generate_series(1, 14) a(r), generate_series(2, 23) b(c)")
def inner_wells(spark, sf_dir):
    return design.wells_table(spark, inner=True)


@query(
    "echo_volumes",
    "WITH x AS (SELECT s_suppkey AS strain, greatest(s_acctbal / 10000 - 0.05, 0.01) AS x FROM supplier), q AS (SELECT quantile_cont(x, 0.5) AS ref FROM x) SELECT strain, CAST(least(greatest(ceil(50 * ref / x / 25) * 25, 50), 400) AS BIGINT) AS shot_nl FROM x, q",
)
def echo_volumes(spark, sf_dir):
    od = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("strain"), (F.col("s_acctbal") / 10000).alias("od"))
    return design.normalised_volumes(od, blank=0.05, ref_quantile=0.5, floor_nl=50, cap_nl=400).select("strain", F.col("shot_nL").alias("shot_nl"))


@query(
    "pair_design_blocks",
    "WITH z AS (SELECT l_suppkey AS s, avg(l_quantity) AS q, avg(l_discount) AS d FROM lineitem GROUP BY 1), p AS (SELECT DISTINCT x.l_suppkey AS a, y.l_suppkey AS b FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_suppkey < y.l_suppkey) SELECT a, b, round(x.q - y.q, 6) AS diff_q, round(x.d - y.d, 6) AS diff_d, round(x.q + y.q, 6) AS sum_q, round(x.d + y.d, 6) AS sum_d FROM p JOIN z x ON x.s = a JOIN z y ON y.s = b",
)
def pair_design_blocks(spark, sf_dir):
    from .scoring_queries import _order_pairs

    z = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.array(F.avg("l_quantity"), F.avg("l_discount")).alias("z"))
    both = _order_pairs(spark, sf_dir).join(z.select(F.col("l_suppkey").alias("a"), F.col("z").alias("za")), "a").join(z.select(F.col("l_suppkey").alias("b"), F.col("z").alias("zb")), "b")
    x = features.pair_design(F.col("za"), F.col("zb"), symmetric=False)
    return both.withColumn("x", x).select("a", "b", *[r6(F.col("x")[k]).alias(n) for k, n in enumerate(("diff_q", "diff_d", "sum_q", "sum_d"))])


@query(
    "stream_trend",
    "SELECT date_trunc('hour', ts) AS start, count(*) AS n, round(avg(CASE WHEN event_type = 'click' THEN 1.0 ELSE 0.0 END), 6) AS share_good, round(avg(value), 6) AS mean_value FROM events GROUP BY 1",
)
def stream_trend(spark, sf_dir):
    """The hourly trend as a stream that runs once over the events and stops.

    Files of a finished table come in no order of time, so no event is too late."""
    from tessera.storage import shared_path
    from tessera.streaming import run_trend

    source = table(spark, sf_dir, "events")
    events = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    trend = run_trend.hourly_trend(events, good=F.col("event_type") == "click", late="100000 days")
    path = shared_path(spark, "trend")
    run_trend.run_to_latest(trend, path, shared_path(spark, "trend-state"))
    return run_trend.latest(spark, path, ["start"]).select("start", "n", r6("share_good").alias("share_good"), r6("mean_value").alias("mean_value"))
