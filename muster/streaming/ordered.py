"""Records of a stream in the order of their own time: a buffer that a watermark releases.

The watermark is the newest time seen less ``delay_seconds`` and never goes back.  A record waits until the watermark has passed
its time; what a batch releases is thus complete up to the watermark and lies after all that earlier batches released, in
whatever order records came.  A record older than the watermark before its batch is late: what it belongs to has been released.
Records without a time are late too.

With ``ahead_seconds`` a record moves the watermark only if its time is not later than the clock by more than that, so one record from the
far future does not make all others late; it waits until its time has come.

State is written under the batch's number and read from the batch before: a batch that is run again starts from the
same state and overwrites what it wrote.  The buffer holds no more than the records of the last ``delay_seconds``, and those
from the future.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.functions.durations import micros
from muster.session import remove_folder, written


@dataclass
class Released:
    """What a batch may go on with."""

    ready: DataFrame
    late: DataFrame
    watermark: int | None

    def passed(self, us):
        """Whether the watermark lies beyond a time in microseconds."""
        return F.lit(False) if self.watermark is None else us < F.lit(self.watermark)


@contextmanager
def in_order(
    batch: DataFrame, ts: str, out: str, batch_id: int, delay_seconds: float, ahead_seconds: float | None = None
) -> Iterator[Released]:
    """The records to go on with, for use within the block."""
    spark = batch.sparkSession
    us = micros(F.col(ts))
    before = watermark(spark, out, batch_id - 1)
    with written(batch, "arrived") as arrived:
        timely = arrived
        if ahead_seconds is not None:
            timely = arrived.where(us <= F.lit(int((time.time() + ahead_seconds) * 1_000_000)))
        newest = timely.agg(F.max(us)).first()[0]  # one value
        marks = [m for m in (before, None if newest is None else newest - int(delay_seconds * 1_000_000)) if m is not None]
        now = max(marks, default=None)
        late = arrived.where(F.col(ts).isNull() if before is None else F.col(ts).isNull() | (us < F.lit(before)))
        held = arrived.where(F.col(ts).isNotNull() if before is None else us >= F.lit(before))
        if batch_id > 0:
            held = held.unionByName(waiting(spark, out, batch_id - 1, batch))
        ready = held.where(F.lit(False) if now is None else us < F.lit(now))
        held.where(F.lit(True) if now is None else us >= F.lit(now)).write.mode("overwrite").parquet(f"{out}/waiting/batch={batch_id}")
        late.write.mode("overwrite").parquet(f"{out}/late/batch={batch_id}")
        spark.createDataFrame([(now,)], "watermark bigint").coalesce(1).write.mode("overwrite").parquet(f"{out}/clock/batch={batch_id}")
        yield Released(ready, late, now)
    if batch_id > 1:
        for name in ("waiting", "clock"):
            remove_folder(spark, f"{out}/{name}/batch={batch_id - 2}")


def watermark(spark: SparkSession, out: str, batch_id: int) -> int | None:
    """The watermark after a batch, in microseconds."""
    if batch_id < 0:
        return None
    return spark.read.schema("watermark bigint").parquet(f"{out}/clock/batch={batch_id}").first()[0]


def waiting(spark: SparkSession, out: str, batch_id: int, like: DataFrame) -> DataFrame:
    """The records a batch left waiting."""
    return spark.read.schema(like.schema).parquet(f"{out}/waiting/batch={batch_id}")
