"""Activity records of servers: an append-only table partitioned by day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from muster import schemas


def activity_records(
    df: DataFrame, op: str, ts: str, server: str, display_name: str | None = None, document: str | None = None
) -> DataFrame:
    """Rows in the ``ACTIVITY`` schema."""
    empty = F.lit(None).cast("string")
    return df.select(
        F.col(op).alias("op"),
        F.col(ts).cast("timestamp").alias("ts"),
        F.col(server).cast("string").alias("server"),
        (F.col(display_name) if display_name else empty).alias("serverDisplayName"),
        (F.col(document) if document else empty).alias("serverDoc"),
    )


def _by_day(records: DataFrame) -> DataFrame:
    return records.withColumn("dt", F.to_date("ts"))


def record_activity(records: DataFrame, path: str, enabled: bool = True) -> None:
    """Append records, if activity is logged at all.

    The rebalance hint gives each day few files, and splits a day that is much larger than the others.
    """
    if enabled:
        _by_day(records).hint("rebalance", "dt").write.mode("append").partitionBy("dt").parquet(path)


def stream_activity(records: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append a stream of records; the checkpoint keeps a restarted query from writing any twice."""
    return (
        _by_day(records)
        .writeStream.format("parquet")
        .partitionBy("dt")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**(trigger or {"availableNow": True}))
        .start(path)
    )


def read_activity(spark: SparkSession, path: str) -> DataFrame:
    """The recorded activity; a filter on ``dt`` reads only those days."""
    return spark.read.schema(f"{schemas.ACTIVITY}, dt date").parquet(path)
