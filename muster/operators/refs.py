"""References between servers, clusters and members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster import schemas
from muster.functions.address import display_address, full_address, is_member_address
from muster.operators.skew import join_per_key

# fixed values: document types, the order of reverse lookup, and the text for a dangling reference
SERVER_TYPES = {"Mongod": "server", "ConfigMongod": "server", "Mongos": "router", "mongod": "server", "mongos": "router"}
CLUSTER_TYPES = {"ReplicaSetCluster": "replica", "ShardedCluster": "sharded"}
ROLE_ORDER = ["configServers", "members", "shards"]
INVALID_MEMBER = "<Invalid Member>"


def _typed(docs: DataFrame, types: dict[str, str], default: str) -> tuple[DataFrame, DataFrame]:
    kind = F.when(F.col("_type").isNull(), F.lit(default))
    for name, value in types.items():
        kind = kind.when(F.col("_type") == name, value)
    typed = docs.withColumn("type", kind)
    return typed.where(F.col("type").isNotNull()), typed.where(F.col("type").isNull()).drop("type")


def type_servers(servers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Servers with a normalised ``type``, and apart from them those of an unknown type."""
    return _typed(servers, SERVER_TYPES, "server")


def type_clusters(clusters: DataFrame) -> tuple[DataFrame, DataFrame]:
    return _typed(clusters, CLUSTER_TYPES, "replica")


def explode_members(clusters: DataFrame, cluster_id: str = "_id", field: str = "members") -> DataFrame:
    """One row per list element with its position; a cluster without the list has none."""
    return clusters.select(
        F.col(cluster_id).alias("cluster_id"), F.posexplode(field).alias("pos", "member")
    ).select("cluster_id", F.col("pos").cast("bigint").alias("pos"), "member")


def edges(clusters: DataFrame, source: Column | None = None) -> DataFrame:
    """Every reference a cluster holds: ``(cluster_id, role, pos, child_kind, child_id, source)``.

    ``configServers`` may be one reference (a config replica) or a list of server references.  One pass
    over the clusters: the three lists are joined to one array before it is exploded.
    """

    def entry(role: str, pos: Column, kind: Column | str, child: Column) -> Column:
        return F.struct(
            F.lit(role).alias("role"),
            pos.cast("bigint").alias("pos"),
            (F.lit(kind) if isinstance(kind, str) else kind).alias("child_kind"),
            child.alias("child_id"),
        )

    def listed(role: str, items: Column) -> Column:
        def one(item: Column, pos: Column) -> Column:
            server, cluster = item["server"]["$id"], item["cluster"]["$id"]
            kind = F.when(server.isNotNull(), "server").otherwise("cluster")
            return entry(role, pos, kind, F.coalesce(server, cluster))

        return F.coalesce(F.transform(items, one), F.array())

    text = F.ltrim(F.col("configServers"))
    single = F.from_json(text, schemas.CONFIG_REF)
    several = F.from_json(text, schemas.CONFIG_LIST)
    config = (
        F.when(
            text.startswith("{"), F.array(entry("configServers", F.lit(0), "cluster", single["$id"]))
        )
        .when(
            text.startswith("["),
            F.transform(
                several,
                lambda item, pos: entry(
                    "configServers",
                    pos,
                    F.when(item["server"]["$id"].isNotNull(), "server").otherwise("cluster"),
                    F.coalesce(item["server"]["$id"], item["$id"]),
                ),
            ),
        )
        .otherwise(F.array())
    )
    together = F.concat(listed("members", F.col("members")), listed("shards", F.col("shards")), config)
    return (
        clusters.select(
            F.col("_id").alias("cluster_id"),
            (source if source is not None else F.lit("file")).alias("source"),
            F.explode(together).alias("edge"),
        )
        .select("cluster_id", "edge.*", "source")
        .where(F.col("child_id").isNotNull())
    )


def resolve_refs(
    members: DataFrame,
    ref: str,
    servers: DataFrame,
    server_id: str,
    address: Column,
    host: str | None = None,
    port: Column | None = None,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Add ``server_id``, ``server_address`` and ``label`` to members.

    Only where there is no reference is a server built from a well-formed ``host``; its id is that address.
    Server ids are unique in a catalog, so the join keeps one row per member.
    """
    catalog = servers.select(
        F.col(server_id).alias(ref), F.col(server_id).alias("_sid"), full_address(address, port).alias("_address"),
    )
    joined = join_per_key(members, catalog, [ref], "left", hot)
    found, found_address = F.col("_sid").cast("string"), F.col("_address")
    if host is not None:
        built = F.when(F.col(ref).isNull() & is_member_address(F.col(host)), F.col(host))
        found, found_address = F.coalesce(found, built), F.coalesce(found_address, built)
    return joined.select(
        *members.columns,
        found.alias("server_id"),
        found_address.alias("server_address"),
        F.coalesce(found, F.lit(INVALID_MEMBER)).alias("label"),
    )


def owners_of(servers: DataFrame, server_id: str, links: DataFrame, child_kind: str = "server") -> DataFrame:
    """The cluster that holds each server: ``owner``, ``owner_role``, ``owner_pos``; null if none.

    Stored documents come before files.  Among files the role order decides, then the lowest cluster id;
    among stored documents only the cluster id.  Edges are reduced to one per child before the join.
    """
    rank = F.array_position(F.array(*[F.lit(r) for r in ROLE_ORDER]), F.col("role"))
    stored = F.col("source") == "database"
    key = F.struct(
        F.when(stored, 0).otherwise(1).alias("a"),
        F.when(stored, 0).otherwise(rank).alias("b"),
        F.col("cluster_id").alias("c"),
        F.col("pos").alias("d"),
        rank.alias("e"),
    )
    best = (
        links.where(F.col("child_kind") == child_kind)
        .groupBy(F.col("child_id").alias("_child"))
        .agg(F.min_by(F.struct("cluster_id", "role", "pos"), key).alias("_owner"))
    )
    return (
        servers.join(best, servers[server_id] == best["_child"], "left")
        .withColumns(
            {
                "owner": F.col("_owner.cluster_id"),
                "owner_role": F.col("_owner.role"),
                "owner_pos": F.col("_owner.pos"),
            }
        )
        .drop("_child", "_owner")
    )


def flatten_topology(links: DataFrame) -> DataFrame:
    """Sharded cluster → shard → member server: ``(root, shard, shard_pos, member_pos, server_id, role)``.

    The depth is fixed, so it is one join of the edges with themselves.  A shard or config entry that is
    a server stands for itself.
    """
    top = links.select(
        F.col("cluster_id").alias("root"),
        F.col("role"),
        F.col("child_id").alias("shard"),
        F.col("pos").alias("shard_pos"),
        "child_kind",
    ).where(F.col("role").isin("shards", "configServers"))
    inner = links.where((F.col("role") == "members") & (F.col("child_kind") == "server")).select(
        F.col("cluster_id").alias("_cluster"),
        F.col("pos").alias("member_pos"),
        F.col("child_id").alias("_server"),
    )
    reach = (top["child_kind"] == "cluster") & (top["shard"] == inner["_cluster"])
    return top.join(inner, reach, "left").select(
        "root",
        "role",
        "shard",
        "shard_pos",
        F.coalesce("member_pos", F.lit(0)).cast("bigint").alias("member_pos"),
        F.when(F.col("child_kind") == "server", F.col("shard")).otherwise(F.col("_server")).alias("server_id"),
    )


def role_columns(arbiter: Column, priority: Column) -> dict[str, Column]:
    """Roles that follow from the member itself; a missing priority is neither passive nor zero."""
    is_arbiter = F.coalesce(arbiter, F.lit(False))
    is_zero = F.coalesce(priority == 0, F.lit(False))
    return {
        "is_arbiter": is_arbiter,
        "is_passive": is_zero,
        "can_become_primary": ~is_arbiter & ~is_zero,
        "in_connection": ~is_arbiter,
    }


def member_roles(
    members: DataFrame,
    cluster_id: str,
    server_id: str,
    arbiter: Column,
    priority: Column,
    links: DataFrame | None = None,
    config_flag: Column | None = None,
) -> DataFrame:
    """Role flags of each member.

    With the edges of all clusters, also ``is_config_server`` (own flag, listed by a sharded cluster, or
    member of a config replica) and ``is_shard_server``.
    """
    own_flag = F.coalesce(config_flag, F.lit(False)) if config_flag is not None else F.lit(False)
    out = members.withColumns(role_columns(arbiter, priority))
    if links is None:
        return out.withColumn("is_config_server", own_flag)
    # one row per referenced child, so neither join adds rows
    used = (
        links.where(F.col("role").isin("configServers", "shards"))
        .groupBy("child_kind", "child_id")
        .agg(
            F.bool_or(F.col("role") == "configServers").alias("_config"),
            F.bool_or(F.col("role") == "shards").alias("_shard"),
        )
    )
    by_cluster = used.where(F.col("child_kind") == "cluster").select(
        F.col("child_id").alias(cluster_id), F.col("_config").alias("_c_config"), F.col("_shard").alias("_c_shard")
    )
    by_server = used.where(F.col("child_kind") == "server").select(
        F.col("child_id").alias(server_id), F.col("_config").alias("_s_config"), F.col("_shard").alias("_s_shard")
    )
    joined = join_per_key(out, by_cluster, [cluster_id], "left")
    joined = join_per_key(joined, by_server, [server_id], "left")

    def either(a: str, b: str) -> Column:
        return F.coalesce(F.col(a), F.lit(False)) | F.coalesce(F.col(b), F.lit(False))

    return (
        joined.withColumn("is_config_server", own_flag | either("_c_config", "_s_config"))
        .withColumn("is_shard_server", either("_c_shard", "_s_shard"))
        .drop("_c_config", "_c_shard", "_s_config", "_s_shard")
    )


def addresses(servers: DataFrame, server_id: str = "_id") -> DataFrame:
    """``normalise_address`` for server documents: declared or default port, and what to show."""
    port = F.try_element_at("cmdOptions", F.lit("port"))
    return normalise_address(servers, "address", port).withColumnRenamed(server_id, "_id")


def normalise_address(
    df: DataFrame, address: str, port: Column | None = None, alternative: str | None = None
) -> DataFrame:
    """Add ``full_address``, ``display_address`` and ``address_error``.

    With ``alternative`` that column replaces the address, and a server without it is in error.
    """
    used = F.col(alternative or address)
    missing = F.when(F.coalesce(used, F.lit("")) == "", "no alternative address") if alternative else F.lit(None)
    return df.withColumns(
        {
            "full_address": full_address(used, port),
            "display_address": display_address(used, port),
            "address_error": missing.cast("string"),
        }
    )

