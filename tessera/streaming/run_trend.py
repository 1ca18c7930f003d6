"""Hourly trends of a running sequencer, as a stream over a drop folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_drop_folder(spark: SparkSession, path: str, schema: StructType | str, *, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def hourly_trend(stream: DataFrame, *, time: str = "ts", value: str = "value", good: Column, late: str = "2 hours", window: str = "1 hour") -> DataFrame:
    """Per window: rows, share of good ones, mean of the value; rows later than ``late`` are dropped by the watermark."""
    return (
        stream.withWatermark(time, late)
        .groupBy(F.window(time, window))
        .agg(F.count("*").alias("n"), F.avg(good.cast("double")).alias("share_good"), F.avg(value).alias("mean_value"))
        .select(F.col("window.start").alias("start"), "n", "share_good", "mean_value")
    )


def first_arrivals(stream: DataFrame, *, key: str = "read_id", time: str = "ts", late: str = "2 hours") -> DataFrame:
    """Each read once, within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def run_to_table(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop; a restart goes on from the checkpoint."""
    query = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()


def run_to_latest(df: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is there and stop, keeping windows that the watermark has not closed, too.

    Every micro-batch writes the rows that it changed to a folder of its own, so a
    batch that runs again replaces itself; :func:`latest` reads the last state of each."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    df.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start().awaitTermination()


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The row of the last batch for each key of a table that :func:`run_to_latest` wrote."""
    rows = spark.read.parquet(path)
    others = [c for c in rows.columns if c not in (*keys, "batch")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("_last"))
    return last.select(*keys, *[F.col("_last")[c].alias(c) for c in others])
