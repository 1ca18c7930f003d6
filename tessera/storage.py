"""Places for intermediate tables that every executor can reach."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; only where that is unset is
    one chosen below the warehouse, which is shared as well."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


#: Folders that this process named and has not cleaned up.
_named: set[str] = set()


def shared_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    _named.add(path)
    return path


def clean(spark: SparkSession) -> None:
    """Delete all folders below :func:`shared_root` that this process wrote, once results that read them are written."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _named:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_named.pop())
        path.getFileSystem(conf).delete(path, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage the way ``checkpoint()`` does, but keeps a typed Parquet table
    whose columns later scans can prune; it survives the loss of executors."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, df: DataFrame) -> None:
    """Delete a table written by :func:`materialize` that nothing needs any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(conf).delete(path, True)


#: Rows by strain that are sent to every task (some 100 bytes each); more are joined by key.
SENT_ROWS = 1_000_000


def sent(strains: DataFrame) -> DataFrame:
    """``strains``, a row for each, to be broadcast unless they are too many."""
    return F.broadcast(strains) if strains.count() <= SENT_ROWS else strains


#: Limits of a batch between Spark and Python where rows hold whole texts.
BATCH_ROWS, BATCH_BYTES = 1_000, 16 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's limits of Arrow batches, if they are higher, to BATCH_ROWS and
    BATCH_BYTES: buffers on both sides then follow these, however long the texts are."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, BATCH_ROWS)
    spark.conf.set(size, BATCH_BYTES)
