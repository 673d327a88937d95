"""Snapshots of tables: export, import with checks, replay of a change log."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.operators.lookup import document_condition
from muster.session import folder_names, move_folder, remove_folder, setting

OPEN_FILES = 16


def _condition(df: DataFrame, where: dict | Column | None) -> Column | None:
    return document_condition(df.schema, where) if isinstance(where, dict) else where


def export_snapshot(
    df: DataFrame, out: str, where: dict | Column | None = None, partition_by: Sequence[str] = ()
) -> DataFrame:
    """Write the rows that match to ``out`` (made if missing); returns how many rows each partition got.

    The counts come from what was written, so they also show that it can be read back.  Rows come to the writers by partition,
    so a task has few files open and need not sort its rows first; from ``OPEN_FILES`` on it does.
    """
    condition = _condition(df, where)
    chosen = df if condition is None else df.where(condition)
    if partition_by:
        chosen = chosen.hint("rebalance", *partition_by)
    with setting(df.sparkSession, "spark.sql.maxConcurrentOutputFileWriters", str(OPEN_FILES)):
        chosen.write.mode("errorifexists").partitionBy(*partition_by).parquet(out)
    written = df.sparkSession.read.parquet(out)
    return written.groupBy(*partition_by).agg(F.count(F.lit(1)).alias("rows"))


def read_snapshot(spark: SparkSession, src: str, where: dict | Column | None = None) -> DataFrame:
    """The exported rows; the condition reaches the scan and prunes partitions."""
    df = spark.read.parquet(src)
    condition = _condition(df, where)
    return df if condition is None else df.where(condition)


def import_snapshot(
    spark: SparkSession,
    src: str,
    dest: str,
    where: dict | Column | None = None,
    drop: bool = False,
    schema: str | None = None,
    check: Column | None = None,
    stop_on_error: bool = True,
    rejects: str | None = None,
    load_id: str | None = None,
) -> None:
    """Load an exported snapshot into ``dest``, as its partition ``load=<load_id>``.

    ``drop`` replaces what is there, else rows are added.  With ``schema`` the snapshot must have those
    columns.  ``check`` must hold for every row: a row that fails ends the import, or, with
    ``stop_on_error`` off, goes to ``rejects`` while the others are loaded.

    All rows are written in one pass to a folder readers do not see, and published by renaming it; a failure before that leaves
    ``dest`` as it was.  A load with an id that is there already is not made again, so an import that is repeated under its id
    neither repeats nor loses rows.
    """
    load = f"load={load_id or uuid.uuid4().hex}"
    df = read_snapshot(spark, src, where)
    if "load" in df.columns:
        df = df.drop("load")  # of an earlier import
    if schema is not None:
        wanted = spark.createDataFrame([], schema).schema
        have = {f.name: f.dataType for f in df.schema.fields}
        wrong = [f.name for f in wanted.fields if have.get(f.name) != f.dataType]
        if wrong:
            raise ValueError(f"snapshot {src} lacks or mistypes: {', '.join(wrong)}")
        df = df.select(*[f.name for f in wanted.fields])
    if check is not None and not stop_on_error and rejects is None:
        raise ValueError("name a path for rejected rows")
    good = F.lit(True) if check is None else F.coalesce(check, F.lit(False))
    if stop_on_error:
        row = F.to_json(F.struct(*df.columns))
        failed = F.raise_error(F.concat(F.lit("rejected row: "), row)).cast("boolean")
        good = F.when(good, True).otherwise(failed)
    if load not in folder_names(spark, dest):
        _stage_and_publish(df, good, dest, rejects, load)
    if drop:
        for name in folder_names(spark, dest):
            if name != load:
                remove_folder(spark, f"{dest}/{name}")


def _stage_and_publish(df: DataFrame, good: Column, dest: str, rejects: str | None, load: str) -> None:
    spark, staged = df.sparkSession, f"{dest}/.staged-{load.removeprefix('load=')}"
    df.withColumn("_outcome", F.when(good, "loaded").otherwise("rejected")).write.mode("overwrite").partitionBy("_outcome").parquet(staged)
    targets = {"rejected": rejects, "loaded": dest} if rejects else {"loaded": dest}
    for outcome, target in targets.items():
        folder = f"{staged}/_outcome={outcome}"
        if f"_outcome={outcome}" not in folder_names(spark, staged):
            df.limit(0).write.parquet(folder)  # no rows, but a schema
        if load in folder_names(spark, target):
            remove_folder(spark, f"{target}/{load}")  # left by an attempt that did not come to its end
        move_folder(spark, folder, f"{target}/{load}")
    remove_folder(spark, staged)


def replay_changes(
    base: DataFrame | None,
    log: DataFrame,
    key: str,
    op: str,
    order: Sequence[str],
    payload: Sequence[str],
    until: Column | None = None,
    delete: str = "delete",
) -> DataFrame:
    """The state after replaying a change log on a base, up to a point in time.

    The last change of a key decides: a deletion removes it, anything else replaces it.  Changes are
    reduced to one per key before the shuffle.
    """
    applied = log if until is None else log.where(until)
    last = applied.groupBy(key).agg(
        F.max_by(F.struct(F.col(op).alias("_op"), *payload), F.struct(*order)).alias("_c")
    )
    if base is None:
        return last.where(F.col("_c._op") != delete).select(key, *[f"_c.{p}" for p in payload])
    before = base.select(key, F.struct(*payload).alias("_b"))
    merged = before.join(last, key, "full_outer")
    touched = F.col("_c").isNotNull()
    return merged.where(~touched | (F.col("_c._op") != delete)).select(
        key, *[F.when(touched, F.col(f"_c.{p}")).otherwise(F.col(f"_b.{p}")).alias(p) for p in payload]
    )
