"""Batch forms of the activity jobs: up-time intervals and awaited outcomes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.functions.durations import micros
from muster.operators.ordered import nearest, time_pieces
from muster.operators.skew import HOT_ROWS


def lifecycle_intervals(
    activity: DataFrame,
    server: str,
    ts: str,
    seq: str,
    op: str,
    start: str = "start",
    stop: str = "stop",
    piece_seconds: int = 86_400,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """One row per start: ``(server, started, started_seq, stopped, pending)``.

    The interval ends at the next record of the server if that is a stop.  A start followed by another
    start (a crash left no stop) has no end.  A start with nothing after it is ``pending``.
    """
    kept = activity.where(F.col(op).isin(start, stop)).select(
        server, F.col(ts).alias("_ts"), F.col(seq).alias("_seq"), F.col(op).alias("_op"), micros(F.col(ts)).alias("_us")
    )
    paired = nearest(
        kept,
        [server],
        ["_us", "_seq"],
        [time_pieces(F.col("_us"), piece_seconds)],
        [F.col("_ts").alias("ts"), F.col("_op").alias("op")],
        F.lit(True),
        "_next",
        after=True,
        hot_rows=hot_rows,
    )
    return paired.where(F.col("_op") == start).select(
        server,
        F.col("_ts").alias("started"),
        F.col("_seq").alias("started_seq"),
        F.when(F.col("_next.op") == stop, F.col("_next.ts")).alias("stopped"),
        F.col("_next").isNull().alias("pending"),
    )


def await_outcome(
    requests: DataFrame,
    confirmations: DataFrame,
    key: Sequence[str],
    request_ts: str,
    confirmation_ts: str,
    timeout_seconds: Column | float,
    keep: Sequence[str] = (),
    piece_seconds: int = 86_400,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """The first confirmation after each request and within the timeout: ``confirmed`` and ``met``.

    Both sides are put in one time order and each request looks ahead to the next confirmation, so the
    work grows with the rows; a join on the key alone would pair every request of a busy key with every
    confirmation.  A confirmation at the very time of the request does not count.
    """
    key = list(key)
    asked = requests.select(
        *key, *keep, micros(F.col(request_ts)).alias("_us"), F.lit(1).alias("_turn"), F.col(request_ts).alias("requested"),
        F.lit(None).cast(requests.schema[request_ts].dataType).alias("_at"),
    )
    told = confirmations.select(
        *key, micros(F.col(confirmation_ts)).alias("_us"), F.lit(0).alias("_turn"), F.col(confirmation_ts).alias("_at")
    )
    both = asked.unionByName(told, allowMissingColumns=True)
    # at equal times confirmations sort first, which makes "after" strict
    ahead = nearest(
        both,
        key,
        ["_us", "_turn"],
        [time_pieces(F.col("_us"), piece_seconds)],
        [F.col("_at").alias("ts"), F.col("_us").alias("us")],
        F.col("_turn") == 0,
        "_next",
        after=True,
        hot_rows=hot_rows,
    )
    limit = timeout_seconds if isinstance(timeout_seconds, Column) else F.lit(timeout_seconds)
    met = F.coalesce(F.col("_next.us") <= F.col("_us") + (limit.cast("double") * 1_000_000).cast("bigint"), F.lit(False))
    return ahead.where(F.col("_turn") == 1).select(
        *key, *keep, "requested", F.when(met, F.col("_next.ts")).alias("confirmed"), met.alias("met")
    )
