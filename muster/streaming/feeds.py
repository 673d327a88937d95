"""Continuous forms: logs, activity intervals, awaited outcomes, latest status.

State that must outlive a micro-batch is written by that batch under its id, and the next batch reads what that one
left.  A batch that is run again after a failure overwrites its own folders, so results stay exact, and the work
inside a batch is the same distributed plan as in the batch form, hot servers included.  Records may come in any order:
see ``muster.streaming.ordered`` for the watermark that puts them in order and for what counts as late.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from muster.functions.durations import micros
from muster.operators.activity import await_outcome, lifecycle_intervals
from muster.operators.ordered import count_pieces, with_position
from muster.operators.skew import hot_groups, join_per_key
from muster.session import folder_names, remove_folder, written
from muster.sources.growing import SPLIT_BYTES, growing_text
from muster.sources.logs import parse_log
from muster.streaming.keyed import BUCKETS, FAN, KeyedTable
from muster.streaming.ordered import in_order, waiting

DELAY_SECONDS = 600


def _run(stream: DataFrame, step, checkpoint: str, trigger: dict) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _last(spark: SparkSession, folder: str) -> int:
    """The highest batch number in a folder; -1 if there is none."""
    return max((int(n.split("=")[1]) for n in folder_names(spark, folder) if n.startswith("batch=")), default=-1)


def follow_log(
    spark: SparkSession, path: str, out: str, checkpoint: str, pattern: str = "*", split_bytes: int = SPLIT_BYTES, **trigger
) -> StreamingQuery:
    """Parse log files as they grow: every finished line once, with the record it belongs to.

    Lines are counted per file from 0 over all batches, and a line that continues a record begun in an earlier batch is given
    to that record: of each file the lines so far and its last record are kept.  See ``growing_text`` for what is read when; the
    sizes of the files are kept in ``out`` too, which pyarrow's file systems have to open as they do ``path``.
    """
    state = StructType.fromDDL("file string, lines bigint, record bigint, level string, ts timestamp, batch bigint")

    def step(batch: DataFrame, batch_id: int) -> None:
        heads = KeyedTable(batch.sparkSession, f"{out}/heads", ["file"], ["batch"], state)
        with written(batch, "lines") as lines:
            hot = hot_groups(lines, ["file"])  # counted where they lie, not behind each window again
            numbered = with_position(lines, ["file"], ["at"], [count_pieces(F.col("at"), SPLIT_BYTES)], "line", hot=hot)
            earlier = heads.lookup(batch_id - 1, lines.select("file")).select(
                "file", F.col("lines").alias("_lines"), F.col("record").alias("_record"), F.col("level").alias("_level"), F.col("ts").alias("_ts")
            )
            shift = F.coalesce("_lines", F.lit(0).cast("bigint"))
            records = join_per_key(parse_log(numbered, hot=hot), earlier, ["file"], "left", hot).select(
                "file", (F.col("line") + shift).alias("line"), F.coalesce(F.col("record") + shift, "_record").alias("record"),
                F.coalesce("level", "_level").alias("level"), F.coalesce("ts", "_ts").alias("ts"), "message", "continued",
            )
            folder = f"{out}/records/batch={batch_id}"
            records.write.mode("overwrite").parquet(folder)
            done = batch.sparkSession.read.schema(records.schema).parquet(folder)
            newest = done.groupBy("file").agg(
                (F.max("line") + 1).alias("lines"), F.max_by(F.struct("record", "level", "ts"), "line").alias("_head")
            )
            heads.write(batch_id, newest.select("file", "lines", "_head.*", F.lit(batch_id).cast("bigint").alias("batch")))

    return _run(growing_text(spark, path, pattern, split_bytes, f"{out}/listings"), step, checkpoint, trigger)


def read_records(spark: SparkSession, out: str) -> DataFrame:
    """All log lines so far and the ``batch`` each came in."""
    return spark.read.parquet(f"{out}/records")


def follow_intervals(
    activity: DataFrame,
    server: str,
    ts: str,
    seq: str,
    op: str,
    out: str,
    checkpoint: str,
    start: str = "start",
    stop: str = "stop",
    delay_seconds: float = DELAY_SECONDS,
    ahead_seconds: float | None = None,
    piece_seconds: int = 86_400,
    **trigger,
) -> StreamingQuery:
    """Pair starts with stops over a stream whose records come in any order, up to ``delay_seconds`` late.

    Records are paired once the watermark has passed them.  Between batches only the waiting records are kept and, per server,
    a start that nothing followed yet.  Late records are written to ``late`` and pair with nothing.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        records = batch.where(F.col(op).isin(start, stop)).select(
            F.col(server).alias("server"), F.col(ts).alias("ts"), F.col(seq).alias("seq"),
            F.when(F.col(op) == start, "start").otherwise("stop").alias("op"),
        )
        with in_order(records, "ts", out, batch_id, delay_seconds, ahead_seconds) as feed, written(feed.ready, "ready") as ready:
            table = _pending_table(spark, out, records.schema)
            earlier = table.lookup(batch_id - 1, ready.select("server"))
            both = ready.unionByName(earlier.select("server", "ts", "seq", F.lit("start").alias("op")))
            intervals = lifecycle_intervals(both, "server", "ts", "seq", "op", piece_seconds=piece_seconds)
            with written(intervals, "intervals") as found:
                found.where("not pending").write.mode("overwrite").parquet(f"{out}/settled/batch={batch_id}")
                number = F.lit(batch_id).cast("bigint").alias("batch")
                # the last record of a server decides: a start is pending, after a stop nothing is
                newest = both.groupBy("server").agg(F.max_by(F.struct("ts", "seq", "op"), F.struct("ts", "seq")).alias("_last"))
                table.write(batch_id, newest.select("server", "_last.ts", "_last.seq", (F.col("_last.op") != "start").alias("gone"), number))

    return _run(activity, step, checkpoint, trigger)


def _pending_table(spark: SparkSession, out: str, records: StructType) -> KeyedTable:
    fields = ", ".join(f"{c} {records[c].dataType.simpleString()}" for c in ("server", "ts", "seq"))
    schema = StructType.fromDDL(f"{fields}, gone boolean, batch bigint")
    return KeyedTable(spark, f"{out}/pending", ["server"], ["batch"], schema, gone="gone")


def read_intervals(spark: SparkSession, out: str) -> DataFrame:
    """``server, started, started_seq, stopped, pending``: what is settled, and what the records still waiting make of the rest."""
    last = _last(spark, f"{out}/waiting")
    settled = spark.read.parquet(f"{out}/settled/*")
    like = spark.createDataFrame([], StructType.fromDDL(
        f"server {settled.schema['server'].dataType.simpleString()}, ts {settled.schema['started'].dataType.simpleString()}, "
        f"seq {settled.schema['started_seq'].dataType.simpleString()}, op string"
    ))
    starts = _pending_table(spark, out, like.schema).rows(last).select("server", "ts", "seq", F.lit("start").alias("op"))
    rest = lifecycle_intervals(waiting(spark, out, last, like).unionByName(starts), "server", "ts", "seq", "op")
    return settled.unionByName(rest)


def follow_outcomes(
    records: DataFrame,
    key: Sequence[str],
    ts: str,
    is_request: Column,
    is_confirmation: Column,
    timeout_seconds: int,
    out: str,
    checkpoint: str,
    keep: Sequence[str] = (),
    delay_seconds: float = DELAY_SECONDS,
    ahead_seconds: float | None = None,
    **trigger,
) -> StreamingQuery:
    """The first confirmation of each request over a stream whose records come in any order, up to ``delay_seconds`` late.

    No pairs are made: each batch looks ahead from the requests the watermark has passed and from those that are neither met
    nor past their timeout.  A request is settled when it is met or when the watermark has passed its deadline.  A
    confirmation that comes later than the watermark counts as none, so its request is not met; a request that does is settled at
    once as not met, with ``late`` set.
    """
    key, keep = list(key), list(keep)

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(*key, *keep, F.col(ts).alias("ts"), is_request.alias("_asks"), is_confirmation.alias("_tells"))
        with in_order(rows.where("_asks or _tells"), "ts", out, batch_id, delay_seconds, ahead_seconds) as feed:
            asked = feed.ready.where("_asks").select(*key, *keep, "ts")
            if batch_id > 0:
                asked = asked.unionByName(spark.read.schema(asked.schema).parquet(f"{out}/open/batch={batch_id - 1}"))
            outcomes = await_outcome(asked, feed.ready.where("_tells"), key, "ts", "ts", timeout_seconds, keep)
            deadline = micros(F.col("requested")) + int(timeout_seconds * 1_000_000)
            with written(outcomes.withColumn("_open", ~F.col("met") & ~feed.passed(deadline)), "outcomes") as found:
                found.where("_open").select(*key, *keep, F.col("requested").alias("ts")).write.mode("overwrite").parquet(
                    f"{out}/open/batch={batch_id}")
                late = feed.late.where("_asks").select(
                    *key, *keep, F.col("ts").alias("requested"), F.lit(None).cast(asked.schema["ts"].dataType).alias("confirmed"),
                    F.lit(False).alias("met"), F.lit(True).alias("late"),
                )
                settled = found.where("not _open").drop("_open").withColumn("late", F.lit(False))
                settled.unionByName(late).write.mode("overwrite").parquet(f"{out}/settled/batch={batch_id}")
        if batch_id > 1:
            remove_folder(spark, f"{out}/open/batch={batch_id - 2}")

    return _run(records, step, checkpoint, trigger)


def read_outcomes(
    spark: SparkSession, out: str, key: Sequence[str], timeout_seconds: int, keep: Sequence[str] = ()
) -> DataFrame:
    """Every request with its outcome so far: what is settled, and what the records still waiting make of the rest."""
    last = _last(spark, f"{out}/waiting")
    settled = spark.read.parquet(f"{out}/settled/*")
    fields = ", ".join(f"`{c}` {settled.schema[c].dataType.simpleString()}" for c in (*key, *keep))
    asks = f"{fields}, ts {settled.schema['requested'].dataType.simpleString()}"
    held = spark.read.schema(f"{asks}, _asks boolean, _tells boolean").parquet(f"{out}/waiting/batch={last}")
    asked = spark.read.schema(asks).parquet(f"{out}/open/batch={last}").unionByName(held.where("_asks").drop("_asks", "_tells"))
    rest = await_outcome(asked, held.where("_tells"), key, "ts", "ts", timeout_seconds, keep)
    return settled.unionByName(rest.withColumn("late", F.lit(False)))


def status_feed(
    snapshots: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    out: str,
    checkpoint: str,
    fan: int = FAN,
    buckets: int = BUCKETS,
    **trigger,
) -> StreamingQuery:
    """Keep the newest row per key of a stream of snapshots, in whatever order they come.

    A batch writes the keys it saw; see ``KeyedTable`` for how the table is kept small to read without writing it whole.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        KeyedTable(batch.sparkSession, out, key, order, batch.schema, fan=fan, buckets=buckets).write(batch_id, batch)

    return _run(snapshots, step, checkpoint, trigger)


def read_latest(
    spark: SparkSession, out: str, key: Sequence[str], order: Sequence[str], schema: StructType, fan: int = FAN, buckets: int = BUCKETS
) -> DataFrame:
    """The newest row of every key."""
    return KeyedTable(spark, out, key, order, schema, fan=fan, buckets=buckets).rows()
