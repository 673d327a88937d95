"""Filters and first-match lookups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from muster.functions.uris import is_fleet_uri
from muster.operators.skew import join_per_key


def _path_matches(value: Column, kind: T.DataType, path: list[str], wanted) -> Column:
    if isinstance(kind, T.ArrayType):
        return F.exists(value, lambda e: _path_matches(e, kind.elementType, path, wanted))
    if not path:
        return value.isNull() if wanted is None else value == F.lit(wanted)
    if isinstance(kind, T.MapType):
        return _path_matches(value[path[0]], kind.valueType, path[1:], wanted)
    if path[0] not in kind.names:  # a property that is not there reads as null
        return F.lit(wanted is None)
    return _path_matches(value[path[0]], kind[path[0]].dataType, path[1:], wanted)


def document_condition(schema: T.StructType, query: dict) -> Column:
    """Equality, ``$or``, and dotted paths that may pass through arrays."""
    terms = []
    for name, wanted in query.items():
        if name == "$or":
            terms.append(reduce(or_, [document_condition(schema, q) for q in wanted]))
            continue
        first, *rest = name.split(".")
        if first not in schema.names:
            terms.append(F.lit(wanted is None))
        else:
            terms.append(_path_matches(F.col(f"`{first}`"), schema[first].dataType, rest, wanted))
    return F.coalesce(reduce(and_, terms, F.lit(True)), F.lit(False))


def match_documents(df: DataFrame, query: dict) -> DataFrame:
    return df.where(document_condition(df.schema, query))


def classify_targets(
    targets: DataFrame,
    target: str,
    servers: DataFrame,
    server_id: str,
    clusters: DataFrame,
    cluster_id: str,
    paths: DataFrame | None = None,
    path: str = "path",
) -> DataFrame:
    """What each ``id[/database]``, URI or path stands for.

    Adds ``target_id``, ``database`` and ``kind``: server (looked up before cluster), cluster, uri, path,
    ambiguous (both an address and a path) or invalid (neither).
    """

    def known(table: DataFrame, column: str, flag: str) -> DataFrame:
        return table.select(F.col(column).cast("string").alias(f"_{flag}")).distinct().withColumn(flag, F.lit(True))

    parts = F.split(F.col(target), "/")
    out = targets.withColumn("_parts", F.size(parts)).withColumn("target_id", F.get(parts, F.lit(0)))
    for table, column, flag in ((servers, server_id, "_is_server"), (clusters, cluster_id, "_is_cluster")):
        hits = known(table, column, flag)
        out = join_per_key(out, hits.withColumnRenamed(f"_{flag}", "target_id"), ["target_id"], "left")
    if paths is not None:
        hits = known(paths, path, "_is_path")
        out = join_per_key(out, hits.withColumnRenamed("__is_path", target), [target], "left")
    else:
        out = out.withColumn("_is_path", F.lit(None).cast("boolean"))
    uri = is_fleet_uri(F.col(target))
    short = F.col("_parts") <= 2
    server = short & F.col("_is_server").isNotNull()
    cluster = short & F.col("_is_cluster").isNotNull()
    address = uri | server | cluster
    kind = (
        F.when(address & F.col("_is_path").isNotNull(), "ambiguous")
        .when(uri, "uri")
        .when(server, "server")
        .when(cluster, "cluster")
        .when(F.col("_is_path").isNotNull(), "path")
        .otherwise("invalid")
    )
    return (
        out.withColumn("kind", kind)
        .withColumn("database", F.when(F.col("_parts") == 2, F.get(parts, F.lit(1))))
        .drop("_parts", "_is_server", "_is_cluster", "_is_path")
    )


def any_member(df: DataFrame, group: Sequence[str], predicate: Column, name: str = "any") -> DataFrame:
    """Whether any row of the group meets the predicate; a null predicate does not."""
    return df.groupBy(*group).agg(F.bool_or(F.coalesce(predicate, F.lit(False))).alias(name))


def pick_first(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    predicate: Column,
    values: Sequence[Column | str],
    defer: Column | None = None,
) -> DataFrame:
    """The first row of each group, in order, that meets the predicate; ``defer`` rows come last."""
    key = [F.col(c) for c in order]
    if defer is not None:
        key = [F.coalesce(defer, F.lit(False)).alias("_defer"), *key]
    first = F.min_by(F.struct(*values), F.struct(*key)).alias("_first")
    return df.where(predicate).groupBy(*group).agg(first).select(*group, "_first.*")


def suggest_primary(
    members: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    can_become_primary: Column,
    resolved: Column,
    online_here: Column,
    values: Sequence[Column | str],
) -> DataFrame:
    return pick_first(members, group, order, can_become_primary & resolved & online_here, values)


def first_config(
    members: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    config: str,
    primary: Column,
    arbiter: Column,
) -> DataFrame:
    """The configuration to trust: the primary's (even if it has none), else the first found, arbiters last."""
    ranked = members.withColumn(
        "_turn", F.when(F.coalesce(primary, F.lit(False)), 0).when(F.coalesce(arbiter, F.lit(False)), 2).otherwise(1)
    )
    readable = (F.col("_turn") == 0) | F.col(config).isNotNull()
    return pick_first(ranked, group, ["_turn", *order], readable, [config])


def first_source(
    requests: DataFrame, holdings: DataFrame, keys: Sequence[str], source: str, source_order: str
) -> DataFrame:
    """The first source that holds what is asked for; null, and ``missing`` set, where none does.

    Holdings are reduced to one row per key first, so the join cannot fan out.
    """
    best = holdings.groupBy(*keys).agg(F.min_by(source, source_order).alias(source))
    return join_per_key(requests, best, keys, "left").withColumn("missing", F.col(source).isNull())


def top_rows(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows per group; Spark cuts each map task's groups to ``n`` before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")
