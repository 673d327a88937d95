"""Listings, single documents and connection templates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.functions.text import ascii_only, text_or_empty
from muster.functions.uris import SCHEME
from muster.operators.ordered import PART_ROWS, ordered_concat


def listing(df: DataFrame, key: str, columns: dict[str, Column]) -> DataFrame:
    """Rows sorted by key, missing texts shown as empty and non-ASCII characters dropped."""
    shown = [ascii_only(text_or_empty(v)).alias(k) for k, v in columns.items()]
    return df.select(F.col(key), *shown).orderBy(key)


def member_listing(
    clusters: DataFrame,
    cluster_id: str,
    members: DataFrame,
    member_cluster: str,
    order: Sequence[str],
    split: Sequence[Column],
    label: Column,
    hot: DataFrame | None = None,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """Clusters with their members as ``[ a, b ]``.

    Every ``part_rows`` members are a part; the parts of a cluster joined by ``", "`` are the whole text.
    """
    texts = ordered_concat(
        members, [member_cluster], order, split, label, "members", separator=", ", part_rows=part_rows, hot=hot
    )
    named = texts.withColumnRenamed(member_cluster, "_cluster")
    joined = clusters.join(named, clusters[cluster_id] == named["_cluster"], "left").drop("_cluster")
    part, parts = F.coalesce("part", F.lit(0).cast("bigint")), F.coalesce("parts", F.lit(1).cast("bigint"))
    begin, end = F.when(part == 0, "[ ").otherwise(""), F.when(part == parts - 1, " ]").otherwise("")
    return joined.withColumns(
        {"part": part, "parts": parts, "members": F.concat(begin, F.coalesce("members", F.lit("")), end)}
    )


def show(df: DataFrame, key: str, value, pretty: bool = True) -> DataFrame:
    """One document as JSON; an error if it is missing.  The filter reaches the scan."""
    found = df.where(F.col(key) == F.lit(value)).agg(
        F.min(F.to_json(F.struct(*df.columns), {"pretty": str(pretty).lower()})).alias("document")
    )
    missing = F.raise_error(F.lit(f"no document with {key} {value!r}"))
    return found.select(F.coalesce(F.col("document"), missing.cast("string")).alias("document"))


def server_uri(address: Column, auth: Column, database: Column | None = None) -> Column:
    """Connection template of a server with its placeholders."""
    chosen = F.nullif(database, F.lit("")) if database is not None else F.lit(None).cast("string")
    tail = F.coalesce(F.concat(F.lit("/"), chosen), F.when(auth, "/[dbname]").otherwise(""))
    return F.concat(
        F.lit(f"{SCHEME}://"), F.when(auth, "[dbuser]:[dbpass]@").otherwise(""), address, tail
    )


def cluster_uri(
    members: DataFrame,
    cluster_id: str,
    order: Sequence[str],
    split: Sequence[Column],
    address: Column,
    connects: Column,
    database: str | None = None,
    auth: DataFrame | None = None,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Connection template per cluster: the non-arbiter addresses in member order.

    ``auth`` has ``(cluster_id, auth)``.  The parts of ``ordered_concat`` join with a comma: the first carries the
    beginning, the last the end.
    """
    hosts = ordered_concat(members.where(connects), [cluster_id], order, split, address, "hosts", hot=hot)
    if auth is not None:
        hosts = hosts.join(auth.select(cluster_id, "auth"), cluster_id, "left")
    flag = F.coalesce(F.col("auth"), F.lit(False)) if auth is not None else F.lit(False)
    first, last = F.col("part") == 0, F.col("part") == F.col("parts") - 1
    tail = F.lit(f"/{database}") if database else F.when(flag, "/<dbname>").otherwise("")
    return hosts.select(
        cluster_id,
        "part",
        "parts",
        F.concat(
            F.when(first, f"{SCHEME}://").otherwise(""),
            F.when(first & flag, "<dbuser>:<dbpass>@").otherwise(""),
            F.col("hosts"),
            F.when(last, F.concat(tail, F.lit("?replicaSet="), F.col(cluster_id).cast("string"))).otherwise(""),
        ).alias("uri"),
    )


def replica_addresses(
    members: DataFrame,
    cluster_id: str,
    order: Sequence[str],
    split: Sequence[Column],
    address: Column,
    hot: DataFrame | None = None,
    replica: Column | None = None,
) -> DataFrame:
    """``id/h1,h2``: the form a shard or a config replica is named by.

    Where ``replica`` is false for a cluster's members, they are a list of servers or a single one: ``h1,h2,h3``.
    """
    named = members.withColumn("_replica", F.lit(True) if replica is None else F.coalesce(replica, F.lit(False)))
    hosts = ordered_concat(named, [cluster_id, "_replica"], order, split, address, "hosts", hot=hot)
    name = F.when(F.col("_replica"), F.concat(F.col(cluster_id).cast("string"), F.lit("/"))).otherwise("")
    return hosts.select(
        cluster_id,
        "part",
        "parts",
        F.concat(F.when(F.col("part") == 0, name).otherwise(""), F.col("hosts")).alias("replica_address"),
    )
