"""Groups and joins in which one key may hold a large share of all rows.

Hot keys are found before a plan is made, by a sketch that each task fills in its scan: no key is shuffled, and what the tasks
hand on has a bound.  Where there are none, windows and joins are the plain ones and nothing is dealt out or repeated in them;
where one side of a join is small enough to be broadcast, as the planner knows without a job, nothing is looked for.  A
list made for a table is handed to all that start from it.  It is the only thing broadcast without a further check.  It
holds at most ``HOT_GROUPS`` rows, whatever the size of the input, and every key with more than ``3.5 / 32768`` of all rows if it
has ``hot_rows``.  The list decides how rows are dealt out, never what comes out; it names a key by its hash, so two keys of one hash are
both dealt out.
"""

from __future__ import annotations

import weakref
from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

HOT_ROWS = 1_000_000
HOT_GROUPS = 5_000
#: Items a sketch tracks, and how many sketches are merged before the last merge.
TRACKED, MERGES = 20_000, 256
NULL_SHARES = 1024
#: A table below this many bytes a row of a hot group is taken to hold none, and not read to find out.
ROW_BYTES = 16
#: Bytes of a table, as the planner estimates them, of which one task holds the groups; with more tasks than ``MANY_TASKS`` a task takes more.
TASK_BYTES, MANY_TASKS = 4 << 20, 2_000
_NONE_HOT: weakref.WeakSet[DataFrame] = weakref.WeakSet()


def hot_groups(
    df: DataFrame, group: Sequence[str], hot_rows: int = HOT_ROWS, most: int = HOT_GROUPS
) -> DataFrame:
    """The groups with at least ``hot_rows`` rows by hash: ``_key, _rows``, no more than the ``most`` largest.

    They are counted now, nearly; the result holds the list itself.  A table that the planner knows to be small is not counted.
    """
    if size_of(df) <= hot_rows * ROW_BYTES:
        none = df.sparkSession.createDataFrame([], "_key bigint, _rows bigint")
        _NONE_HOT.add(none)
        return none
    keyed = df.select(F.xxhash64(*group).alias("_key"), F.pmod(F.spark_partition_id(), F.lit(MERGES)).alias("_part"))
    each = keyed.groupBy("_part").agg(F.expr(f"approx_top_k_accumulate(_key, {TRACKED}) AS _sketch"))
    # grouped by a constant, so that no rows give no sketch
    whole = each.groupBy(F.lit(1)).agg(F.expr(f"approx_top_k_combine(_sketch, {TRACKED}) AS _sketch"))
    found = whole.select(F.expr(f"inline(approx_top_k_estimate(_sketch, {most}))"))
    return measured(found.toDF("_key", "_rows").where(F.col("_rows") >= hot_rows))


def measured(listed: DataFrame) -> DataFrame:
    """A bounded list of hot groups, run now and held as a local table of known size."""
    found = listed.toArrow()
    held = listed.sparkSession.createDataFrame(found, listed.schema)
    if not len(found):
        _NONE_HOT.add(held)
    return held


def none_hot(listed: DataFrame) -> bool:
    """Whether a list from ``hot_groups`` is known to be empty."""
    return listed in _NONE_HOT


def marks(df: DataFrame, listed: DataFrame, keys: Sequence[str], like: DataFrame | None = None) -> Column:
    """Where a row of ``df`` belongs to a listed key, the list being joined under its own names prefixed by ``_hot``.

    ``like`` has the key columns the list was made from, whose types the hash depends on.
    """
    if "_key" in listed.columns:
        same = df if like is None else like
        return F.xxhash64(*[df[k].cast(same.schema[k].dataType) for k in keys]).eqNullSafe(F.col("_hot_key"))
    return reduce(and_, [df[k].eqNullSafe(F.col(f"_hot_{at}")) for at, k in enumerate(keys)])


def renamed(listed: DataFrame, keys: Sequence[str], *more: Column) -> DataFrame:
    """The list under names that clash with nothing."""
    if "_key" in listed.columns:
        return listed.select(F.col("_key").alias("_hot_key"), *more)
    return listed.select(*[F.col(k).alias(f"_hot_{at}") for at, k in enumerate(keys)], *more)


def _spread(df: DataFrame, parts: Column | int) -> Column:
    """A share number that is the same whenever a task is run again; maps count by their text."""
    def has_map(kind) -> bool:
        if isinstance(kind, ArrayType):
            return has_map(kind.elementType)
        return isinstance(kind, MapType) or isinstance(kind, StructType) and any(has_map(f.dataType) for f in kind.fields)

    columns = [F.to_json(F.struct(df[f.name])) if has_map(f.dataType) else df[f.name] for f in df.schema.fields]
    return F.pmod(F.xxhash64(*columns), F.lit(parts) if isinstance(parts, int) else parts)


def size_of(df: DataFrame) -> int:
    """The planner's estimate of a table's bytes; no job is run."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def is_broadcast(df: DataFrame) -> bool:
    """Whether the planner, by what it knows of the size, broadcasts this side of a join."""
    return size_of(df) <= df._jdf.sparkSession().sessionState().conf().autoBroadcastJoinThreshold()


def dealt(df: DataFrame, keys: Sequence[str], listed: DataFrame) -> DataFrame:
    """A table as it is read or was written, dealt out by key to so many tasks that each sorts few rows, however large the table is.

    Windows and aggregations by these and further columns then need no other shuffle.  A table that the usual tasks hold, and one
    with hot groups, is left as it lies.
    """
    most = max(MANY_TASKS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    tasks = min(size_of(df) // TASK_BYTES, most)
    if tasks <= df.sparkSession.sparkContext.defaultParallelism or not none_hot(listed):
        return df
    return df.repartition(tasks, *keys)


def join_per_key(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    hot: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join a table of any skew with one that has a row (or a few) per key; inner, left, left_semi or left_anti.

    A side that was aggregated by the key and is joined as it lies cannot be split at run time, and its hot
    key would be one task.  So the rows of a hot key are dealt out to as many shares as they hold
    ``hot_rows``, and the right rows of that key are repeated for each share: at most one row more per
    ``hot_rows`` left rows in all.  Rows with a null key match nothing and are dealt out too.  The share is
    part of the join key, which puts a shuffle under either side, so what is still uneven (many copies of
    one row) is split by the adaptive skew rule.  ``hot`` may be a list made for another table that has at
    least these rows.
    """
    keys = list(keys)
    if is_broadcast(right):
        return left.join(right, keys, how)
    listed = hot if hot is not None else hot_groups(left, keys, hot_rows)
    if none_hot(listed):
        return left.join(right, keys, how)
    shares = F.broadcast(renamed(listed, keys, F.ceil(F.col("_rows") / hot_rows).cast("bigint").alias("_shares")))
    names = [c for c in shares.columns if c != "_shares"]
    no_key = reduce(or_, [F.col(k).isNull() for k in keys])
    dealt = (
        left.join(shares, marks(left, listed, keys), "left")
        .withColumn(
            "_share",
            F.when(no_key, _spread(left, NULL_SHARES))
            .when(F.col("_shares").isNotNull(), _spread(left, F.col("_shares")))
            .otherwise(F.lit(0).cast("bigint")),
        )
        .drop("_shares", *names)
    )
    last = F.coalesce(F.col("_shares"), F.lit(1).cast("bigint")) - 1
    repeated = (
        right.join(shares, marks(right, listed, keys, left), "left")
        .withColumn("_share", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
        .drop("_shares", *names)
    )
    return dealt.join(repeated, [*keys, "_share"], how).drop("_share")
