"""Readers and small views of the driver tables that several queries share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import pairs, scoring


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(x: Column | str) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, 6)


def order_wells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as wells: lines are reads, the return flag calls them, a discount of a tenth is off target."""
    flag = F.col("l_returnflag")
    call = F.when(F.col("l_discount") >= 0.1, "off_target").when(flag == "A", "strain1").when(flag == "N", "strain2").otherwise("ambiguous")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sample_id"), call.alias("read_class"))
    return scoring.score_wells(lines, by=["sample_id"])


ORDER_WELLS = """
reads AS (
  SELECT l_orderkey AS sample_id, CASE WHEN l_discount >= 0.1 THEN 'off_target' WHEN l_returnflag = 'A' THEN 'strain1' WHEN l_returnflag = 'N' THEN 'strain2' ELSE 'ambiguous' END AS c FROM lineitem
), wells AS (
  SELECT sample_id, count(*) AS n_reads, count(*) FILTER (c = 'strain1') AS n_strain1, count(*) FILTER (c = 'strain2') AS n_strain2,
    count(*) FILTER (c = 'ambiguous') AS n_ambiguous, count(*) FILTER (c = 'off_target') AS n_off_target FROM reads GROUP BY 1
)"""


def supplier_wells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wells of supplier pairs: every order with lines of two suppliers is one well of that pair.

    A line's quantity gives its supplier's reads.  Lines are dealt by order once:
    sums by order and supplier and both sides of the join keep that partitioning."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_returnflag").repartition("l_orderkey")
    reads = lines.groupBy("l_orderkey", "l_suppkey").agg(F.sum("l_quantity").cast("long").alias("n"), F.max((F.col("l_returnflag") == "R").cast("int")).alias("amb"))
    one = reads.select("l_orderkey", F.col("l_suppkey").alias("strain1"), F.col("n").alias("n_strain1"), F.col("amb").alias("amb1"))
    two = reads.select("l_orderkey", F.col("l_suppkey").alias("strain2"), F.col("n").alias("n_strain2"), F.col("amb").alias("amb2"))
    both = one.join(two, "l_orderkey").filter(F.col("strain1") < F.col("strain2"))
    counts = both.withColumns({"n_ambiguous": F.col("amb1") + F.col("amb2"), "n_off_target": F.lit(0)}).withColumn("n_reads", F.col("n_strain1") + F.col("n_strain2") + F.col("n_ambiguous"))
    return pairs.canonical(scoring.well_scores(counts.drop("amb1", "amb2")))


SUPPLIER_WELLS = """
sreads AS (
  SELECT l_orderkey, l_suppkey, CAST(sum(l_quantity) AS BIGINT) AS n, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS amb FROM lineitem GROUP BY 1, 2
), swells AS (
  SELECT x.l_orderkey, x.l_suppkey AS strain_a, y.l_suppkey AS strain_b, x.n AS n1, y.n AS n2, x.amb + y.amb AS n_ambiguous, x.n + y.n + x.amb + y.amb AS n_reads,
    (x.n + 0.5 * (x.amb + y.amb)) / (x.n + y.n + x.amb + y.amb) AS ra, log2((x.n + 0.5) / (y.n + 0.5)) AS lr, (x.amb + y.amb) / (x.n + y.n + x.amb + y.amb) AS unc
  FROM sreads x JOIN sreads y ON x.l_orderkey = y.l_orderkey AND x.l_suppkey < y.l_suppkey
), spairs AS (
  SELECT strain_a, strain_b, count(*) AS n_replicates, avg(n_reads) AS mean_n_reads, avg(ra) AS mra, stddev_samp(ra) AS sra,
    CASE WHEN count(*) > 1 THEN max(ra) - min(ra) END AS rra, avg(lr) AS mlr, stddev_samp(lr) AS slr, avg(unc) AS munc FROM swells GROUP BY 1, 2
)"""
