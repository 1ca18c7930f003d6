"""Edit distances, ranks, twins and verdicts on part and nation names."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import sequence as S
from tessera.operators import identity as I
from tessera.operators import quality
from tessera.operators.graph import connected_components

from .registry import query
from .tables import r6, table

NAMES = "names AS (SELECT DISTINCT p_name AS name FROM part)"
DIST = f"{NAMES}, d AS (SELECT a.name AS query, b.name AS ref, levenshtein(a.name, b.name) AS bp, levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name)) AS dist FROM names a CROSS JOIN names b)"


def names(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_name").alias("seq")).distinct()


def nation_names(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return n.select(F.col("n_name").alias("name"), F.col("n_name").alias("seq"))


def found(spark, sf_dir, **how):
    n = names(spark, sf_dir)
    return I.distances(n, n, **how)


@query("edit_nn", f"WITH {DIST}, o AS (SELECT * FROM d WHERE query <> ref), m AS (SELECT query, min(bp) AS bp FROM o GROUP BY 1) SELECT query, min(ref) AS best, bp, count(*) AS n_ties FROM o JOIN m USING (query, bp) GROUP BY query, bp")
def edit_nn(spark, sf_dir):
    out = I.nearest(found(spark, sf_dir).filter("query <> ref"))
    return out.select("query", "best", "bp", F.size("ties").cast("long").alias("n_ties"))


@query("best_hits3", f"WITH {DIST} SELECT query, ref, CAST(row_number() OVER w AS INTEGER) AS hit, round(dist, 6) AS dist FROM d WINDOW w AS (PARTITION BY query ORDER BY dist, ref) QUALIFY row_number() OVER w <= 3")
def best_hits3(spark, sf_dir):
    return I.best_hits(found(spark, sf_dir)).select("query", "ref", "hit", r6("dist").alias("dist"))


@query("bounded_edit", f"WITH {DIST} SELECT query, ref, bp, round(dist, 6) AS dist FROM d WHERE bp <= 3")
def bounded_edit(spark, sf_dir):
    return found(spark, sf_dir, limit=3).select("query", "ref", "bp", r6("dist").alias("dist"))


@query(
    "rank_retrieval",
    f"""WITH {NAMES}, q AS (SELECT name, substr(name, 2) || 'x' AS seq FROM names), d AS (SELECT a.name AS query, b.name AS ref, levenshtein(a.seq, b.name) / greatest(length(a.seq), length(b.name)) AS dist FROM q a CROSS JOIN names b),
k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY dist, ref) AS k, rank() OVER (PARTITION BY query ORDER BY dist) AS r FROM d)
SELECT query, max(ref) FILTER (k = 1) AS best, round(max(dist) FILTER (k = 1), 6) AS best_dist, round(max(dist) FILTER (k = 2) - max(dist) FILTER (k = 1), 6) AS margin, CAST(min(r) FILTER (ref = query) AS INTEGER) AS self_rank FROM k GROUP BY 1""",
)
def rank_retrieval(spark, sf_dir):
    n = names(spark, sf_dir)
    q = n.select("name", F.concat(F.substring("name", 2, 1000), F.lit("x")).alias("seq"))
    out = I.attribution(I.distances(q, n), n.select(F.col("name").alias("query"), F.col("name").alias("expected")))
    return out.select("query", "best", r6("best_dist").alias("best_dist"), r6("margin").alias("margin"), "self_rank")


@query(
    "rank_summary",
    f"""WITH {NAMES}, q AS (SELECT name, substr(name, 4) AS seq FROM names), d AS (SELECT a.name AS query, b.name AS ref, levenshtein(a.seq, b.name) / greatest(length(a.seq), length(b.name)) AS dist FROM q a CROSS JOIN names b),
k AS (SELECT *, rank() OVER (PARTITION BY query ORDER BY dist) AS r FROM d), s AS (SELECT r FROM k WHERE query = ref)
SELECT count(*) AS n, round(avg(CASE WHEN r <= 1 THEN 1.0 ELSE 0.0 END), 6) AS top1, round(avg(CASE WHEN r <= 5 THEN 1.0 ELSE 0.0 END), 6) AS top5, round(avg(CASE WHEN r <= 10 THEN 1.0 ELSE 0.0 END), 6) AS top10, median(r) AS median_rank FROM s""",
)
def rank_summary(spark, sf_dir):
    n = names(spark, sf_dir)
    a = I.attribution(I.distances(n.select("name", F.substring("name", 4, 1000).alias("seq")), n), n.select(F.col("name").alias("query"), F.col("name").alias("expected")))
    return I.rank_summary(a).select("n", *[r6(c).alias(c) for c in ("top1", "top5", "top10")], "median_rank")


@query("twin_sets", f"WITH {DIST} SELECT query AS name, ref AS twin FROM d WHERE dist <= 0.45 AND query <> ref")
def twin_sets(spark, sf_dir):
    return I.twins(found(spark, sf_dir), 0.45)


@query(
    "name_components",
    f"WITH RECURSIVE {DIST}, e AS (SELECT query AS a, ref AS b FROM d WHERE dist <= 0.4), r AS (SELECT a AS v, b AS c FROM e UNION SELECT r.v, e.b FROM r JOIN e ON r.c = e.a) SELECT v AS vertex, min(c) AS component FROM r GROUP BY 1",
)
def name_components(spark, sf_dir):
    return connected_components(found(spark, sf_dir).filter("dist <= 0.4"), "query", "ref")


@query("separable_names", f"WITH {DIST}, s AS (SELECT query, count(*) FILTER (bp < 5 AND query <> ref) AS c FROM d GROUP BY 1) SELECT count(*) FILTER (c = 0) AS n_separable, count(*) AS n FROM s")
def separable_names(spark, sf_dir):
    return I.separable(found(spark, sf_dir), 5)


@query(
    "identity_verdict",
    """WITH q AS (SELECT n_name AS query, n_name AS expected, substr(n_name, 2) AS seq FROM nation UNION ALL SELECT 'ATLANTIS', 'ATLANTIS', 'ATLANTIS'), d AS (SELECT query, n_name AS ref, levenshtein(seq, n_name) / greatest(length(seq), length(n_name)) AS dist FROM q CROSS JOIN nation),
b AS (SELECT query, ref AS best_hit, dist AS best_dist FROM d QUALIFY row_number() OVER (PARTITION BY query ORDER BY dist, ref) = 1),
t AS (SELECT x.n_name AS name, y.n_name AS twin FROM nation x JOIN nation y ON x.n_name <> y.n_name AND levenshtein(x.n_name, y.n_name) / greatest(length(x.n_name), length(y.n_name)) <= 0.5)
SELECT q.query, q.expected, best_hit, round(best_dist, 6) AS best_dist, round(o.dist - best_dist, 6) AS margin,
  CASE WHEN n.n_name IS NULL THEN 'absent' WHEN best_hit = q.expected THEN 'supported' WHEN EXISTS (SELECT 1 FROM t WHERE name = q.expected AND twin = best_hit) THEN 'ambiguous' ELSE 'contradicted' END AS verdict
FROM q JOIN b USING (query) LEFT JOIN d o ON o.query = q.query AND o.ref = q.expected LEFT JOIN nation n ON n.n_name = q.expected""",
)
def identity_verdict(spark, sf_dir):
    refs = nation_names(spark, sf_dir)
    q = refs.select("name", F.substring("name", 2, 1000).alias("seq")).unionByName(spark.createDataFrame([("ATLANTIS", "ATLANTIS")], "name string, seq string"))
    out = I.verdicts(I.distances(q, refs), q.select(F.col("name").alias("query"), F.col("name").alias("expected")), I.twins(I.distances(refs, refs), 0.5), refs)
    return out.select("query", "expected", "best_hit", r6("best_dist").alias("best_dist"), r6("margin").alias("margin"), "verdict")


@query(
    "support_summary",
    "WITH v AS (SELECT o_orderpriority AS reference, CASE o_custkey % 4 WHEN 0 THEN 'supported' WHEN 1 THEN 'contradicted' WHEN 2 THEN 'ambiguous' ELSE 'absent' END AS verdict FROM orders) SELECT reference, count(*) FILTER (verdict = 'supported') AS supported, count(*) FILTER (verdict = 'contradicted') AS contradicted, count(*) FILTER (verdict = 'ambiguous') AS ambiguous, count(*) FILTER (verdict = 'absent') AS absent, count(*) FILTER (verdict IN ('supported', 'contradicted')) AS n_decidable, round(count(*) FILTER (verdict = 'supported') / count(*) FILTER (verdict IN ('supported', 'contradicted')), 6) AS label_support FROM v GROUP BY 1",
)
def support_summary(spark, sf_dir):
    k = F.col("o_custkey") % 4
    v = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("reference"), F.when(k == 0, "supported").when(k == 1, "contradicted").when(k == 2, "ambiguous").otherwise("absent").alias("verdict"))
    s = quality.support_summary(v, ["reference"])
    return s.withColumn("label_support", r6("label_support"))


@query(
    "agreement_sources",
    "WITH s AS (SELECT p_brand AS strain, p_size % 3 AS source, p_name AS seq FROM part) SELECT x.strain, x.source AS source_a, y.source AS source_b, round(max(1 - levenshtein(x.seq, y.seq) / greatest(length(x.seq), length(y.seq))), 6) AS identity FROM s x JOIN s y ON x.strain = y.strain AND x.source < y.source GROUP BY 1, 2, 3",
)
def agreement_sources(spark, sf_dir):
    s = table(spark, sf_dir, "part").select(F.col("p_brand").alias("strain"), (F.col("p_size") % 3).alias("source"), F.col("p_name").alias("seq"))
    return I.agreement(s).withColumn("identity", r6("identity"))


@query("collapse_copies", "SELECT p_brand AS name, arg_min(p_name, (-length(p_name), p_name)) AS longest, arg_min(p_name, (levenshtein(p_name, 'blue ivory'), p_name)) AS nearest, count(*) AS n_copies FROM part GROUP BY 1")
def collapse_copies(spark, sf_dir):
    copies = table(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), F.col("p_name").alias("seq"))
    longest = I.collapse_copies(copies).select("name", F.col("seq").alias("longest"), "n_copies")
    return longest.join(I.collapse_copies(copies, F.lit("blue ivory")).select("name", F.col("seq").alias("nearest")), "name").select("name", "longest", "nearest", "n_copies")


@query(
    "constrained_mapping",
    """WITH w AS (SELECT c_custkey AS sample_id, x.n_name AS strain1, CASE WHEN c_custkey % 5 = 0 THEN x.n_name WHEN c_custkey % 7 = 0 THEN 'MISSING' ELSE y.n_name END AS strain2, c_mktsegment AS read FROM customer JOIN nation x ON x.n_nationkey = c_nationkey JOIN nation y ON y.n_nationkey = (c_nationkey + 7) % 25),
c AS (SELECT sample_id, read, strain1 AS s, 0 AS o FROM w UNION ALL SELECT sample_id, read, strain2, 1 FROM w WHERE strain1 <> strain2 AND strain2 <> 'MISSING'), d AS (SELECT *, levenshtein(read, s) / greatest(length(read), length(s)) AS dist FROM c), k AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY dist, o) AS k FROM d)
SELECT sample_id, max(s) FILTER (k = 1) AS best_match_strain, round(max(dist) FILTER (k = 1), 6) AS best_dist, round(max(dist) FILTER (k = 2) - max(dist) FILTER (k = 1), 6) AS margin_to_runner_up, CAST(count(*) AS INTEGER) AS n_candidates FROM k GROUP BY 1""",
)
def constrained_mapping(spark, sf_dir):
    refs = nation_names(spark, sf_dir)
    n = table(spark, sf_dir, "nation")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sample_id"), "c_nationkey", F.col("c_mktsegment").alias("seq"))
    one = n.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("strain1"))
    two = n.select(((F.col("n_nationkey") + 18) % 25).alias("c_nationkey"), F.col("n_name").alias("_two"))
    w = c.join(one, "c_nationkey").join(two, "c_nationkey")
    k = F.col("sample_id")
    w = w.withColumn("strain2", F.when(k % 5 == 0, F.col("strain1")).when(k % 7 == 0, "MISSING").otherwise(F.col("_two")))
    out = I.constrained_mapping(w.select("sample_id", F.lit(1).alias("read_id"), "seq"), I.expected_candidates(w, refs))
    return out.select("sample_id", "best_match_strain", r6("best_dist").alias("best_dist"), r6("margin_to_runner_up").alias("margin_to_runner_up"), "n_candidates")


@query(
    "reference_pair_distances",
    """WITH p AS (SELECT DISTINCT least(a, b) AS strain_a, greatest(a, b) AS strain_b FROM (SELECT x.n_name AS a, CASE WHEN x.n_nationkey % 6 = 0 THEN 'ZZZ' ELSE y.n_name END AS b FROM nation x JOIN nation y ON y.n_nationkey = (x.n_nationkey * 3 + 1) % 25))
SELECT strain_a, strain_b, levenshtein(x.n_name, y.n_name) AS bp_dist, round(levenshtein(x.n_name, y.n_name) / greatest(length(x.n_name), length(y.n_name)), 6) AS norm_dist, x.n_name IS NULL OR y.n_name IS NULL AS missing_reference FROM p LEFT JOIN nation x ON x.n_name = strain_a LEFT JOIN nation y ON y.n_name = strain_b""",
)
def reference_pair_distances(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    x = n.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("a"), ((F.col("n_nationkey") * 3 + 1) % 25).alias("j"))
    p = x.join(n.select(F.col("n_nationkey").alias("j"), F.col("n_name").alias("b")), "j").withColumn("b", F.when(F.col("k") % 6 == 0, "ZZZ").otherwise(F.col("b")))
    p = p.select(F.least("a", "b").alias("strain_a"), F.greatest("a", "b").alias("strain_b"))
    out = I.pair_reference_distances(p, nation_names(spark, sf_dir))
    return out.select("strain_a", "strain_b", "bp_dist", r6("norm_dist").alias("norm_dist"), "missing_reference")


@query("min_pairwise_distance", "SELECT min(levenshtein(x.n_name, y.n_name)) AS min_distance FROM nation x JOIN nation y ON x.n_nationkey < y.n_nationkey")
def min_pairwise_distance(spark, sf_dir):
    n = nation_names(spark, sf_dir)
    return I.distances(n, n).filter("query < ref").agg(F.min("bp").alias("min_distance"))


@query("revcomp_translate", "SELECT doc_id, reverse(translate(text, 'ACGTacgt', 'TGCAtgca')) AS rc, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS letters FROM documents")
def revcomp_translate(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    rc = F.reverse(F.translate("text", "ACGTacgt", "TGCAtgca"))
    return d.select("doc_id", rc.alias("rc"), F.length(F.regexp_replace("text", "[^A-Za-z]", "")).cast("long").alias("letters"))


@query(
    "well_coordinates",
    "SELECT c_custkey, w AS well, CASE WHEN regexp_matches(w, '^[A-P]([1-9]|1[0-9]|2[0-4])$') THEN ascii(w) - 65 END AS row, CASE WHEN regexp_matches(w, '^[A-P]([1-9]|1[0-9]|2[0-4])$') THEN CAST(substr(w, 2) AS INTEGER) END AS col FROM (SELECT c_custkey, chr(CAST(65 + c_custkey % 18 AS INTEGER)) || CAST(c_custkey % 27 AS VARCHAR) AS w FROM customer)",
)
def well_coordinates(spark, sf_dir):
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.chr(65 + k % 18), (k % 27).cast("string")).alias("well"))
    return c.select("c_custkey", "well", S.well_row(F.col("well")).alias("row"), S.well_col(F.col("well")).alias("col"))


@query("sample_ids", "SELECT s_suppkey, printf('Plate%02d_%s', s_suppkey % 16, chr(CAST(65 + s_suppkey % 16 AS INTEGER)) || CAST(1 + s_suppkey % 24 AS VARCHAR)) AS sample_id FROM supplier")
def sample_ids(spark, sf_dir):
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select("s_suppkey", S.sample_id(k % 16, S.well_label(k % 16, 1 + k % 24)).alias("sample_id"))


@query("mask_mismatches", "SELECT x.n_name AS a, y.n_name AS b, CAST(list_sum(list_transform(generate_series(1, least(length(x.n_name), length(y.n_name))), lambda i: CASE WHEN substr(x.n_name, i, 1) IN ('A', 'C', 'G', 'T') AND substr(y.n_name, i, 1) IN ('A', 'C', 'G', 'T') AND substr(x.n_name, i, 1) <> substr(y.n_name, i, 1) THEN 1 ELSE 0 END)) AS INTEGER) AS mismatches FROM nation x JOIN nation y ON x.n_nationkey < y.n_nationkey")
def mask_mismatches(spark, sf_dir):
    plain = F.regexp_replace("n_name", "[^ACGT]", "-")
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("name"), S.base_masks(plain).alias("m"))
    x, y = n.select(F.col("n_nationkey").alias("i"), F.col("name").alias("a"), F.col("m").alias("ma")), n.select(F.col("n_nationkey").alias("j"), F.col("name").alias("b"), F.col("m").alias("mb"))
    return x.join(I.checked(y), F.col("i") < F.col("j")).select("a", "b", S.mask_mismatches(F.col("ma"), F.col("mb"), 0).alias("mismatches"))
