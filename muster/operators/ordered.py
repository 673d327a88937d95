"""Order-dependent columns over groups of any size.

A window over ``partitionBy(group)`` sends a whole group to one task.  Here only groups that are small
enough are treated so.  The rows of hot groups are dealt out by ranges of group and order, of about
``hot_rows`` rows each, and cut further where the caller's coarser form of the order changes; each piece
gets its own window, and a small table with one row per piece of a hot group carries totals and boundary
rows over to the next piece.  The result is the same as that of the plain window.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from muster.operators.skew import HOT_ROWS, hot_groups, marks, none_hot, renamed
from muster.session import materialise

PART_ROWS = 100_000  # values in one text


def time_pieces(ts_micros: Column, seconds: int = 3600) -> Column:
    """Monotone piece number of a time in microseconds."""
    return F.floor(ts_micros / F.lit(seconds * 1_000_000)).cast("bigint")


def count_pieces(position: Column, rows: int = 100_000) -> Column:
    """Monotone piece number of a whole number such as an array position or a line number."""
    return F.floor(position / F.lit(rows)).cast("bigint")


def _same(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> Column:
    condition = F.lit(True)
    for a, b in pairs:
        condition = condition & left[a].eqNullSafe(right[b])
    return condition


def cut_hot_groups(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    split: Sequence[Column],
    hot_rows: int = HOT_ROWS,
    hot: DataFrame | None = None,
) -> tuple[DataFrame, list[str]]:
    """Add the piece columns: null in ordinary groups, range and split in hot ones; none if no group is hot.

    The ranges come from Spark's range partitioning over the whole order, so no piece grows with its group, even where
    the leading order columns or the split are the same in all rows.  They are written down, since another evaluation
    might draw other bounds.

    The list of hot groups has a row bound known to the planner, so it is broadcast only while that
    bound is below ``spark.sql.autoBroadcastJoinThreshold``.  Where ``df`` is a plan with joins, pass
    ``hot`` from ``hot_groups`` of the table it starts from: the rows are then counted where they are read.
    """
    listed = hot if hot is not None else hot_groups(df, group, hot_rows)
    if none_hot(listed):
        return df, []
    ranges = math.ceil((listed.agg(F.sum("_rows")).first()[0] or 0) / hot_rows) + 1
    hot = renamed(listed, group, F.lit(True).alias("_hot"))
    coarse = [f"_piece_{i}" for i in range(len(split))]
    marked = df.join(hot, marks(df, listed, group), "left").select(
        *[df[c] for c in df.columns],
        *[F.when(F.col("_hot"), e).alias(p) for e, p in zip(split, coarse)],
        "_hot",
    )
    ordinary = marked.where(F.col("_hot").isNull()).withColumn("_range", F.lit(None).cast("int"))
    dealt = marked.where("_hot").repartitionByRange(ranges, *[F.col(c) for c in dict.fromkeys([*group, *order])])
    dealt = materialise(dealt.withColumn("_range", F.spark_partition_id()), "ranges")
    return ordinary.unionByName(dealt).drop("_hot"), ["_range", *coarse]


def _attach(df: DataFrame, carried: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Left join of a per-piece value; a null piece never matches."""
    renamed = carried.select(*[F.col(k).alias(f"_c_{k}") for k in keys], value)
    return df.join(renamed, _same(df, renamed, [(k, f"_c_{k}") for k in keys]), "left").drop(
        *[f"_c_{k}" for k in keys]
    )


def _is_cut(pieces: Sequence[str]) -> Column:
    """A row of a hot group has its range set."""
    return F.col(pieces[0]).isNotNull()


def running_total(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    split: Sequence[Column],
    value: Column,
    name: str,
    hot_rows: int = HOT_ROWS,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Sum of ``value`` over the group's rows up to and including each row."""
    group, order = list(group), list(order)
    marked, pieces = cut_hot_groups(
        df.withColumn("_value", value.cast("bigint")), group, order, split, hot_rows, hot
    )
    keys = group + pieces
    window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    if not pieces:
        return marked.withColumn(name, F.coalesce(F.sum("_value").over(window), F.lit(0))).drop("_value")
    earlier = (
        Window.partitionBy(*group).orderBy(*pieces).rowsBetween(Window.unboundedPreceding, -1)
    )
    totals = (
        marked.where(_is_cut(pieces))
        .groupBy(*keys)
        .agg(F.sum("_value").alias("_total"))
        .select(*keys, F.sum("_total").over(earlier).alias("_before"))
    )
    local = marked.withColumn(name, F.sum("_value").over(window))
    return (
        _attach(local, totals, keys, "_before")
        .withColumn(name, F.coalesce(F.col(name), F.lit(0)) + F.coalesce(F.col("_before"), F.lit(0)))
        .drop("_before", "_value", *pieces)
    )


def with_position(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    split: Sequence[Column],
    name: str = "pos",
    hot_rows: int = HOT_ROWS,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Zero-based position of each row in its group."""
    counted = running_total(df, group, order, split, F.lit(1), name, hot_rows, hot)
    return counted.withColumn(name, F.col(name) - 1)


def nearest(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    split: Sequence[Column],
    value: Sequence[Column],
    where: Column,
    name: str,
    after: bool = False,
    inclusive: bool = False,
    hot_rows: int = HOT_ROWS,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Struct of ``value`` from the closest row for which ``where`` holds, before or after each row.

    Null where there is none.  ``order`` must be a total order of the group.
    """
    group, order = list(group), list(order)
    found = F.when(where, F.struct(*value))
    marked, pieces = cut_hot_groups(df.withColumn("_found", found), group, order, split, hot_rows, hot)
    keys = group + pieces

    def directed(names: Sequence[str]) -> list[Column]:
        return [F.col(c).desc() if after else F.col(c).asc() for c in names]

    # looking forward is a backward look in the reversed order, which keeps the frame growing
    window = (
        Window.partitionBy(*keys)
        .orderBy(*directed(order))
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    if not pieces:
        return marked.withColumn(name, F.last("_found", ignorenulls=True).over(window)).drop("_found")
    passed = (
        Window.partitionBy(*group)
        .orderBy(*directed(pieces))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    at = F.when(F.col("_found").isNotNull(), F.struct(*order))
    edge = F.min_by("_found", at) if after else F.max_by("_found", at)
    carried = (
        marked.where(_is_cut(pieces))
        .groupBy(*keys)
        .agg(edge.alias("_edge"))
        .select(*keys, F.last("_edge", ignorenulls=True).over(passed).alias("_carried"))
    )
    local = marked.withColumn(name, F.last("_found", ignorenulls=True).over(window))
    return (
        _attach(local, carried, keys, "_carried")
        .withColumn(name, F.coalesce(F.col(name), F.col("_carried")))
        .drop("_carried", "_found", *pieces)
    )


def ordered_concat(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    split: Sequence[Column],
    value: Column,
    name: str,
    separator: str = ",",
    part_rows: int = PART_ROWS,
    hot: DataFrame | None = None,
) -> DataFrame:
    """The group's values in order, joined to texts of ``part_rows`` values each.

    Every group is cut in the same way, at the multiples of ``part_rows``: ``part`` counts from 0 to ``parts`` - 1, and
    the parts joined in that order by the separator are the whole text.  A group of ``part_rows`` rows or fewer is one
    part.  ``hot`` only saves counting the groups again; it has no influence on the result.
    """
    group, order = list(group), list(order)
    kept = df.select(*dict.fromkeys(group + order), value.cast("string").alias("_text"))
    placed = with_position(kept, group, order, split, "_pos", hot=hot)
    texts = placed.groupBy(*group, F.floor(F.col("_pos") / part_rows).cast("bigint").alias("part")).agg(
        F.expr(f"listagg(_text, '{separator}') within group (order by _pos)").alias(name)
    )
    return texts.select(
        *group, "part", F.count(F.lit(1)).over(Window.partitionBy(*group)).alias("parts"), name
    )
