"""The newest row per key of a stream, as a table in levels.

A micro-batch writes the newest rows of the keys it saw.  Every ``fan`` batches their folders are merged into one of the next
level, every ``fan`` of those into one of the level above, and so on: a row is written once per level, so what is written
follows the keys seen and never the size of the table, and a reader merges at most ``fan - 1`` folders a level.

Folders are named by level and batch, so which ones make up the table after a batch follows from its number alone.  A batch that is
run again overwrites its own folders; what it merged is removed only when the next batch begins.  Rows lie in folders by a
hash of the key, and a reader who needs some keys reads those folders only.

A row whose ``gone`` column is true takes its key out of the table.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from muster.operators.health import latest_snapshot
from muster.session import folder_names, remove_folder, touch

FAN = 8
BUCKETS = 16


class KeyedTable:
    def __init__(
        self, spark: SparkSession, path: str, key: Sequence[str], order: Sequence[str], schema: StructType,
        gone: str | None = None, fan: int = FAN, buckets: int = BUCKETS,
    ):
        if fan < 2:
            raise ValueError("a level takes two folders at least")
        self.spark, self.path, self.key, self.order, self.schema = spark, path, list(key), list(order), schema
        self.gone, self.fan, self.buckets = gone, fan, buckets

    def folder(self, level: int, batch: int) -> str:
        return f"{self.path}/level={level}/batch={batch}"

    def parts(self, batch: int) -> list[tuple[int, int]]:
        """(level, batch) of the folders that make up the table after a batch, oldest first."""
        out, done, level = [], 0, 0
        while self.fan ** (level + 1) <= batch + 1:
            level += 1
        for at in range(level, -1, -1):
            while done + self.fan**at <= batch + 1:
                done += self.fan**at
                out.append((at, done - 1))
        return out

    def merged_by(self, batch: int) -> list[tuple[int, list[tuple[int, int]]]]:
        """The levels a batch writes by merging, each with the folders it merges."""
        out, level = [], 1
        while batch >= 0 and (batch + 1) % self.fan**level == 0:
            step = self.fan ** (level - 1)
            out.append((level, [(level - 1, batch - k * step) for k in range(self.fan - 1, -1, -1)]))
            level += 1
        return out

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _newest(self, rows: DataFrame) -> DataFrame:
        return latest_snapshot(rows, self.key, self.order).select(*self.schema.fieldNames())

    def _read(self, parts: Sequence[tuple[int, int]], keep: Sequence[int] | None = None) -> DataFrame:
        placed = StructType([*self.schema.fields, StructField("_bucket", IntegerType())])
        rows = self.spark.read.schema(placed)
        frames = [rows.parquet(self.folder(*part)) for part in parts]
        out = frames[0] if frames else self.spark.createDataFrame([], placed)
        for frame in frames[1:]:
            out = out.unionByName(frame)
        return (out if keep is None else out.where(F.col("_bucket").isin(*keep))).drop("_bucket")

    def _write(self, rows: DataFrame, level: int, batch: int) -> None:
        placed = rows.withColumn("_bucket", self._bucket())
        placed.write.mode("overwrite").partitionBy("_bucket").parquet(self.folder(level, batch))

    def write(self, batch: int, rows: DataFrame) -> None:
        """The batch's rows, and the levels that are due with it."""
        for _, parts in self.merged_by(batch - 1):
            for part in parts:
                remove_folder(self.spark, self.folder(*part))
        self._write(self._newest(rows.select(*self.schema.fieldNames())), 0, batch)
        for level, parts in self.merged_by(batch):
            merged = self._newest(self._read(parts))
            if self.gone and len(self.parts(batch)) == 1 and level == self.parts(batch)[0][0]:
                merged = merged.where(~F.col(self.gone))  # nothing older is left that the row would hide
            self._write(merged, level, batch)
        touch(self.spark, f"{self.path}/_done/{batch}")
        remove_folder(self.spark, f"{self.path}/_done/{batch - 2}")

    def last_batch(self) -> int:
        """The last batch whose folders are all written; -1 before the first."""
        names = folder_names(self.spark, f"{self.path}/_done")
        return max((int(n) for n in names if n.isdigit()), default=-1)

    def rows(self, batch: int | None = None) -> DataFrame:
        """The table after a batch, the last one if none is named."""
        return self._present(self._read(self.parts(self.last_batch() if batch is None else batch)))

    def _present(self, rows: DataFrame) -> DataFrame:
        newest = self._newest(rows)
        return newest.where(~F.col(self.gone)) if self.gone else newest

    def lookup(self, batch: int, keys: DataFrame) -> DataFrame:
        """The rows of some keys after a batch; only their folders are read, and other keys drop out before the merge."""
        keys = keys.select(*self.key).distinct()
        touched = [r[0] for r in keys.select(self._bucket()).distinct().collect()]  # at most ``buckets`` numbers
        found = self._read(self.parts(batch), touched or [-1])
        named = keys.select(*[F.col(k).alias(f"_k_{k}") for k in self.key])
        same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in self.key])
        return self._present(found.join(named, same, "left_semi"))
