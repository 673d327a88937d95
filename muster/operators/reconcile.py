"""Desired against actual: validation, conflicts, drift, ids and plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from muster.functions import versions
from muster.functions.address import host_of, is_member_address, port_of
from muster.functions.text import gib_to_bytes
from muster.operators.addresses import address_keys, match_addresses
from muster.operators.layers import merge_settings
from muster.operators.lookup import top_rows
from muster.operators.ordered import running_total
from muster.operators.skew import (
    HOT_GROUPS, HOT_ROWS, dealt, hot_groups, join_per_key, marks, measured, none_hot, renamed,
)
from muster.session import materialise

# fixed values
ALLOWED_ENVIRONMENT = ["TCMALLOC_AGGRESSIVE_DECOMMIT"]
CONFIG_SERVER_COUNTS = [1, 3]


def error_list(rules: dict[str, Column]) -> Column:
    """Names of the rules that hold, in the order given."""
    return F.filter(F.array(*[F.when(rule, code) for code, rule in rules.items()]), lambda e: e.isNotNull())


def validate_members(
    members: DataFrame,
    ref: Column,
    host: Column,
    resolved: Column,
    address: Column,
    version: Column | None = None,
) -> DataFrame:
    """``errors`` of members already resolved against the servers; the first rule broken stops the rest."""
    bad_version = version.isNotNull() & ~versions.is_valid(version) if version is not None else F.lit(False)
    code = (
        F.when(ref.isNull() & host.isNull(), "no_server_or_host")
        .when((F.coalesce(host, F.lit("")) != "") & ~is_member_address(host), "bad_host")
        .when(resolved.isNull(), "unresolved_server")
        .when(bad_version, "invalid_version")
        .when(address.isNull(), "no_address")
    )
    return members.withColumn("errors", F.when(code.isNull(), F.array().cast("array<string>")).otherwise(F.array(code)))


def validate_servers(servers: DataFrame, version: str = "mongoVersion", environment: str | None = None) -> DataFrame:
    number = F.col(version)
    valid = versions.is_valid(number)
    rules = {
        "invalid_version": number.isNotNull() & ~valid,
        "unsupported_version": valid & ~versions.is_supported(number),
    }
    if environment is not None:
        rules["unknown_environment_variable"] = F.coalesce(
            F.exists(F.map_keys(environment), lambda k: ~k.isin(ALLOWED_ENVIRONMENT)), F.lit(False)
        )
    return servers.withColumn("errors", error_list(rules))


def validate_clusters(clusters: DataFrame, links: DataFrame, cluster_id: str = "_id") -> DataFrame:
    """A sharded cluster needs a config replica, or a list of one or three config servers."""
    config = (
        links.where(F.col("role") == "configServers")
        .groupBy(F.col("cluster_id").alias("_c"))
        .agg(F.count(F.lit(1)).alias("_n"), F.bool_or(F.col("child_kind") == "cluster").alias("_replica"))
    )
    joined = clusters.join(config, clusters[cluster_id] == config["_c"], "left")
    listed = F.coalesce("_n", F.lit(0))
    wrong = (F.col("_type") == "ShardedCluster") & ~(
        F.coalesce("_replica", F.lit(False)) | listed.isin(CONFIG_SERVER_COUNTS)
    )
    return joined.withColumn("errors", error_list({"config_server_count": wrong})).drop("_c", "_n", "_replica")


def find_conflicts(
    members: DataFrame,
    cluster_id: str,
    pos: str,
    member_id: Column | None,
    server: Column | None,
    address: Column | None,
    hosts: DataFrame | None = None,
    strict: bool = False,
    hot: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Members that repeat an id, a server or an address of an earlier member of their cluster.

    One row per member and kind of clash, with ``first_pos``, the first member it clashes with.  All pairs
    would grow with the square of a group; this form holds the same facts and grows with the members:
    members that clash with the same first one clash with each other.  Id 0 counts as absent unless
    ``strict``.

    The first member of a key is found by a window, for which members dealt out by cluster stay where they are.  Very large
    clusters (``hot``, from ``hot_groups`` by cluster) are reduced to the first member per key, which is joined to all.
    """
    ways: list[Column] = []

    def way(kind: str, key: Column, port: Column | None = None, counts: Column | None = None) -> Column:
        named = F.struct(
            F.lit(kind).alias("kind"),
            key.cast("string").alias("key"),
            F.coalesce(port, F.lit("")).alias("port") if port is not None else F.lit("").alias("port"),
        )
        return F.when(key.isNotNull() if counts is None else counts, named)

    if member_id is not None:
        counted = member_id.isNotNull() if strict else F.coalesce(member_id != 0, F.lit(False))
        ways.append(way("id", member_id, counts=counted))
    if server is not None:
        ways.append(way("server", server))
    if address is not None:
        ways.append(way("address", F.concat(F.lit("host:"), host_of(address)), port_of(address)))
    if not ways:
        raise ValueError("name at least one of member_id, server and address")
    # one pass over the members: each row becomes one row per key it can clash by
    keyed = (
        members.select(cluster_id, pos, F.explode(F.array(*ways)).alias("_way"))
        .where(F.col("_way").isNotNull())
        .select(cluster_id, pos, "_way.*")
    )
    if address is not None and hosts is not None:
        by_ip = address_keys(members, [cluster_id, pos], address, hosts).where(F.col("key_kind") == "ip")
        keyed = keyed.unionByName(by_ip.select(
            cluster_id, pos, F.lit("address").alias("kind"), F.concat(F.lit("ip:"), F.col("key")).alias("key"),
            F.coalesce("port", F.lit("")).alias("port"),
        ))
    by = [cluster_id, "kind", "key", "port"]
    listed = hot if hot is not None else hot_groups(members, [cluster_id], hot_rows)
    ordinary, crowded = keyed, None
    if not none_hot(listed):
        large = F.broadcast(renamed(listed, [cluster_id], F.lit(True).alias("_hot")))
        marked = keyed.join(large, marks(keyed, listed, [cluster_id], members), "left")
        ordinary, crowded = (marked.where(c).select(*keyed.columns) for c in (F.col("_hot").isNull(), F.col("_hot")))
    # a cluster without an id has no members to clash with
    found = ordinary.where(F.col(cluster_id).isNotNull()).withColumn("first_pos", F.min(pos).over(Window.partitionBy(*by)))
    if crowded is not None:
        found = found.unionByName(_with_first(crowded, by, pos, hot_rows))
    return (
        found.where(F.col(pos) > F.col("first_pos"))
        .groupBy(cluster_id, pos, "kind")
        .agg(F.min("first_pos").alias("first_pos"))
    )


def _with_first(keyed: DataFrame, by: Sequence[str], pos: str, hot_rows: int) -> DataFrame:
    """``first_pos`` beside the rows whose key another row has too, where a key may have very many rows."""
    firsts = materialise(
        keyed.groupBy(*by)
        .agg(F.min(pos).alias("first_pos"), F.count(F.lit(1)).alias("_rows"))
        .where(F.col("_rows") > 1),
        "firsts",
    )
    # the same counts name the hot keys
    hot = measured(
        firsts.where(F.col("_rows") >= hot_rows)
        .orderBy(F.col("_rows").desc(), *by)
        .limit(HOT_GROUPS)
    )
    return join_per_key(keyed, firsts.drop("_rows"), by, hot=hot, hot_rows=hot_rows).select(*keyed.columns, "first_pos")


def first_conflict(conflicts: DataFrame, cluster_id: str, pos: str) -> DataFrame:
    """The pair that a check of every pair in order would stop at; id beats server beats address."""
    rank = F.array_position(F.array(F.lit("id"), F.lit("server"), F.lit("address")), F.col("kind"))
    best = F.min(F.struct("first_pos", pos, rank.alias("_rank"), "kind")).alias("_b")
    return conflicts.groupBy(cluster_id).agg(best).select(
        cluster_id, "_b.first_pos", f"_b.{pos}", "_b.kind"
    )


def find_drift(
    members: DataFrame,
    current: DataFrame,
    cluster_id: str,
    pos: str,
    member_id: str,
    address: Column,
    current_address: Column,
    hosts: DataFrame | None = None,
    strict: bool = False,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Members at odds with the current configuration: ``id_moved`` or ``address_renamed``.

    ``current`` has the cluster id, ``id``, ``at`` (array position) and what ``current_address`` needs.  Its ids must be
    unique per cluster, as a server demands of a configuration: one that repeats is an error that names it, if a member
    asks for it.  Where a member has several errors the one latest in the current array wins.  No step compares all pairs: the current side is
    reduced to two rows per address (two, since one may carry the member's own id).  ``hot`` may be the list of the members' hot clusters.
    """
    within = _none_within(hot)
    counted = F.col(member_id).isNotNull() if strict else F.coalesce(F.col(member_id) != 0, F.lit(False))
    given = members.where(counted)
    mine = given.select(cluster_id, pos, F.col(member_id).alias("_id"), address.alias("_address"))
    theirs = current.select(cluster_id, F.col("id").alias("_id"), "at", current_address.alias("_current"))

    my_keys = address_keys(mine, [cluster_id, pos, "_id"], F.col("_address"), hosts)
    their_keys = address_keys(theirs, [cluster_id, "_id", "at"], F.col("_current"), hosts)
    by = [cluster_id, "key_kind", "key", "port"]

    repeated = F.raise_error(F.concat(
        F.lit("id "), F.col("_id").cast("string"), F.lit(" repeats in the current configuration of "), F.col(cluster_id).cast("string")
    )).cast("bigint")
    by_id = theirs.groupBy(cluster_id, "_id").agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("_n"))
    same_id = join_per_key(mine, by_id, [cluster_id, "_id"], hot=within).withColumn(
        "at", F.when(F.col("_n") == 1, F.col("at")).otherwise(repeated)
    ).drop("_n")
    agreeing = my_keys.join(their_keys.drop("at"), [*by, "_id"], "left_semi").select(cluster_id, pos).distinct()
    moved = same_id.join(agreeing, [cluster_id, pos], "left_anti").select(
        cluster_id, pos, "at", F.lit("id_moved").alias("kind"), F.col("_id").alias("current_id")
    )

    last_two = top_rows(their_keys, by, [F.col("at").desc()], 2).withColumnRenamed("_id", "current_id")
    renamed = (
        join_per_key(my_keys, last_two, by, hot=within)
        .where(F.col("_id") != F.col("current_id"))
        .select(cluster_id, pos, "at", F.lit("address_renamed").alias("kind"), "current_id")
    )
    last = F.max_by(F.struct("kind", "current_id"), "at").alias("_e")
    return moved.unionByName(renamed).groupBy(cluster_id, pos).agg(last).select(cluster_id, pos, "_e.*")


#: The checks of a configuration, in the order in which they are made.
REJECT_REASONS = ["invalid_member", "conflict", "drift"]


def configuration_rejects(
    declared: DataFrame,
    current: DataFrame | None,
    cluster_id: str,
    pos: str,
    given_id: str,
    server: Column,
    address: Column,
    current_address: Column | None,
    errors: Column | None = None,
    hosts: DataFrame | None = None,
    hot: DataFrame | None = None,
) -> DataFrame:
    """One row per cluster that cannot be configured: ``reason``, the member's ``pos`` and a ``detail``.

    First every member by itself (``errors``, an array of codes), then members against each other, then against the
    current configuration; within a check the first member in order.  ``declared`` is best a table as it was written.
    """
    hot = hot if hot is not None else hot_groups(declared, [cluster_id])
    def found(df: DataFrame, reason: str, detail: Column) -> DataFrame:
        turn = F.lit(REJECT_REASONS.index(reason))
        return df.select(cluster_id, F.struct(turn.alias("turn"), F.col(pos).alias("pos"), detail.alias("detail")).alias("_r"))

    lying = dealt(declared, [cluster_id], hot)
    clashes = first_conflict(
        find_conflicts(lying, cluster_id, pos, F.col(given_id), server, address, hosts, hot=hot), cluster_id, pos
    )
    out = found(clashes, "conflict", F.col("kind"))
    if errors is not None:
        wrong = declared.withColumn("_errors", errors).where(F.size("_errors") > 0)
        out = out.unionByName(found(wrong, "invalid_member", F.col("_errors")[0]))
    if current is not None:
        drift = find_drift(declared, current, cluster_id, pos, given_id, address, current_address, hosts, hot=hot)
        out = out.unionByName(found(drift, "drift", F.col("kind")))
    reasons = F.array(*[F.lit(r) for r in REJECT_REASONS])
    return out.groupBy(cluster_id).agg(F.min("_r").alias("_r")).select(
        cluster_id, F.element_at(reasons, F.col("_r.turn") + 1).alias("reason"), F.col("_r.pos").alias("pos"), "_r.detail"
    )


def assign_ids(
    members: DataFrame,
    current: DataFrame | None,
    cluster_id: str,
    pos: str,
    given: str,
    address: Column,
    current_address: Column | None,
    split: Sequence[Column],
    hosts: DataFrame | None = None,
    name: str = "member_id",
    configured: DataFrame | None = None,
    hot: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Give every member an id.

    A given id is kept; else the id of the first current member with the same address; else the next free
    number: from the highest current id plus one, from 1 if the current configuration (listed in
    ``configured``) has no members, from 0 if there is none.  Numbers are used up only by members that
    need one, in array order; given ids are not reserved.
    """
    out = members.withColumn("_address", address)
    hot = hot if hot is not None else hot_groups(members, [cluster_id], hot_rows)
    if current is None:
        out = out.withColumn("_matched", F.lit(None).cast("bigint")).withColumn("_start", F.lit(0).cast("bigint"))
    else:
        theirs = current.select(cluster_id, "id", "at", current_address.alias("_current"))
        known = theirs.select(cluster_id, "id")
        if configured is not None:
            known = known.unionByName(configured.select(cluster_id, F.lit(0).cast("bigint").alias("id")))
        starts = known.groupBy(cluster_id).agg(
            (F.greatest(F.max("id"), F.lit(0)) + 1).cast("bigint").alias("_start")
        )
        matched = _with_match(out, theirs, cluster_id, pos, given, hosts, hot)
        out = join_per_key(matched, starts, [cluster_id], "left", hot)
    needs = F.col(given).isNull() & F.col("_matched").isNull()
    counted = running_total(
        out, [cluster_id], [pos], split, needs.cast("bigint"), "_used", hot_rows=hot_rows,
        hot=hot,
    )
    fresh = F.coalesce(F.col("_start"), F.lit(0)) + F.col("_used") - 1
    return counted.withColumn(
        name, F.coalesce(F.col(given).cast("bigint"), F.col("_matched"), fresh)
    ).drop("_address", "_matched", "_start", "_used")


def _with_match(
    out: DataFrame, theirs: DataFrame, cluster_id: str, pos: str, given: str, hosts: DataFrame | None, hot: DataFrame
) -> DataFrame:
    """``_matched``: for members without a given id, that of the first current member with the same ``_address``.

    By names alone an address has one key, so all members meet the first current member of their key in one join, those
    who ask for none under a null key; with a host table the members that ask are matched by all their keys and joined back.
    """
    needy = F.col(given).isNull()
    if hosts is not None:
        matches = match_addresses(
            out.where(needy).select(cluster_id, pos, "_address"), [cluster_id, pos], F.col("_address"),
            theirs, ["id"], ["at"], F.col("_current"), scope=[cluster_id], hosts=hosts,
        ).select(cluster_id, pos, F.col("match.id").cast("bigint").alias("_matched"))
        return out.join(matches, [cluster_id, pos], "left")
    by = [cluster_id, "_host", "_port"]
    firsts = (
        theirs.select(cluster_id, host_of(F.col("_current")).alias("_host"), port_of(F.col("_current")).alias("_port"), "id", "at")
        .where(F.col("_host").isNotNull())
        .groupBy(*by)
        .agg(F.min(F.struct("at", "id"))["id"].cast("bigint").alias("_matched"))
    )
    asking = out.withColumns({
        "_host": F.when(needy, host_of(F.col("_address"))), "_port": F.when(needy, port_of(F.col("_address"))),
    })
    return join_per_key(asking, firsts, by, "left", _none_within(hot)).drop("_host", "_port")


def _none_within(hot: DataFrame | None) -> DataFrame | None:
    """Where no cluster is hot, no part of one is: the empty list then holds for keys within clusters too."""
    return hot if hot is not None and none_hot(hot) else None


def alternate_tags(tags: Column, host: Column, arbiter: Column, alternatives: dict[str, Column]) -> Column:
    """Tags with the alternate addresses that differ from the host; arbiters keep theirs as they are."""
    extra = F.map_filter(
        F.map_from_arrays(
            F.array(*[F.lit(k) for k in alternatives]), F.array(*[v.cast("string") for v in alternatives.values()])
        ),
        lambda k, v: (F.coalesce(v, F.lit("")) != "") & (v != host),
    )
    merged = F.coalesce(merge_settings(tags, extra), tags)
    return F.when(F.coalesce(arbiter, F.lit(False)), tags).otherwise(merged)


def build_desired(
    declared: DataFrame,
    current: DataFrame | None,
    cluster_id: str,
    pos: str,
    host: Column,
    keep: Sequence[str] = (),
    tags: Column | None = None,
    only: Column | None = None,
    add: Column | None = None,
) -> DataFrame:
    """The desired member list, one row per member: cluster id, position, host and the kept properties.

    Default: all declared members.  ``only``: just those that match.  ``add``: the current members first,
    then the matching declared ones.  Where source properties are kept, ``host`` replaces both the
    reference and the declared host.
    """
    columns = {cluster_id: F.col(cluster_id), pos: F.col(pos).cast("bigint"), "host": host}
    columns |= {c: F.col(c) for c in keep}
    if tags is not None:
        columns["tags"] = tags
    chosen = declared
    if add is not None:
        chosen = declared.where(add)
    elif only is not None:
        chosen = declared.where(only)
    wanted = chosen.select(*[v.alias(k) for k, v in columns.items()], F.lit(1).alias("turn"))
    if add is None:
        return wanted
    existing = current.select(
        *[F.col(c) if c in current.columns else F.lit(None).alias(c) for c in columns], F.lit(0).alias("turn")
    )
    return existing.unionByName(wanted, allowMissingColumns=True)


def desired_header(
    clusters: DataFrame,
    current: DataFrame,
    cluster_id: str,
    declared_settings: Column,
    config_replica: Column,
) -> DataFrame:
    """Cluster-level part of a desired configuration: next version, merged settings, config flag."""
    now = current.select(cluster_id, F.col("version").alias("_version"), F.col("settings").alias("_settings"))
    return clusters.join(now, cluster_id, "left").select(
        cluster_id,
        (F.col("_version") + 1).cast("bigint").alias("version"),
        merge_settings(F.col("_settings"), declared_settings).alias("settings"),
        F.when(config_replica, True).alias("configsvr"),
    )


def plan_additions(declared: DataFrame, listed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Declared rows that are not there yet."""
    return declared.join(listed, list(keys), "left_anti")


def already_listed(declared: DataFrame, listed: DataFrame, keys: Sequence[str]) -> DataFrame:
    return declared.join(listed, list(keys), "left_semi")


def plan_relocation(holdings: DataFrame, moves: DataFrame, shards: DataFrame, shard: str, shard_id: str) -> DataFrame:
    """A move for everything held by a drained shard.

    ``moves`` has one row ``(shard, destination)`` per drained shard; a destination that is no shard sets
    ``error`` instead of silently planning nothing.
    """
    known = shards.select(F.col(shard_id).alias("_known")).distinct()
    targets = moves.join(known, moves["destination"] == known["_known"], "left").select(
        shard,
        "destination",
        F.when(F.col("_known").isNull(), F.lit("unknown destination")).alias("error"),
    )
    return holdings.join(targets, shard)


def verify_applied(
    expected: DataFrame,
    observed: DataFrame,
    keys: Sequence[str],
    expected_version: str,
    observed_version: str,
    force: Column | bool = False,
) -> DataFrame:
    """Whether each expected version was seen; a missing one reads as 0, a forced one may be higher."""
    forced = F.lit(force) if isinstance(force, bool) else force
    seen = F.coalesce(F.col(observed_version), F.lit(0))
    difference = seen - F.col(expected_version)
    return (
        expected.join(observed, list(keys), "left")
        .withColumn("applied", (difference == 0) | (forced & (difference >= 0)))
        .withColumn(observed_version, seen)
    )


def cache_size_applied(declared_gib: Column, is_float: Column, observed_bytes: Column) -> Column:
    """Checked only for fractional sizes; whole ones are passed to the server as an option."""
    return ~is_float | F.coalesce(gib_to_bytes(declared_gib) == observed_bytes, F.lit(False))
