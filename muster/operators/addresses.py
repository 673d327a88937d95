"""Do two ``host:port`` addresses mean the same server?"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.functions.address import host_of, port_of
from muster.operators.skew import join_per_key


def host_ips(hosts: DataFrame, host: str = "host", ips: str = "ips") -> DataFrame:
    """Long form ``(host, ip)`` of a host table that holds arrays."""
    return hosts.select(F.col(host).alias("host"), F.explode(ips).alias("ip")).distinct()


def address_keys(
    df: DataFrame, keep: Sequence[str], address: Column, hosts: DataFrame | None = None
) -> DataFrame:
    """One row per way to recognise an address: its host name and each of its IPs, with the port.

    Two addresses are the same if they share a row, so sameness becomes an equi-join.  A host that is
    not in the host table has its name only.  The table is read once: the IPs come as an array per host, which is
    joined by the host and unfolded together with the name.
    """
    named = df.select(*keep, host_of(address).alias("_host"), port_of(address).alias("port")).where(F.col("_host").isNotNull())
    if hosts is None:
        return named.select(*keep, F.lit("host").alias("key_kind"), F.col("_host").alias("key"), "port")
    known = hosts.groupBy(F.col("host").cast("string").alias("_host")).agg(F.collect_set(F.col("ip").cast("string")).alias("_ips"))
    found = join_per_key(named, known, ["_host"], "left")

    def way(kind: str, key: Column) -> Column:
        return F.struct(F.lit(kind).alias("key_kind"), key.alias("key"))

    ips = F.transform(F.coalesce("_ips", F.expr("cast(array() as array<string>)")), lambda ip: way("ip", ip))
    ways = F.inline(F.concat(F.array(way("host", F.col("_host"))), ips))
    return found.select(*keep, "port", ways).select(*keep, "key_kind", "key", "port")


def match_addresses(
    left: DataFrame,
    left_id: Sequence[str],
    left_address: Column,
    right: DataFrame,
    right_value: Sequence[str],
    right_order: Sequence[str],
    right_address: Column,
    scope: Sequence[str] = (),
    hosts: DataFrame | None = None,
) -> DataFrame:
    """For each left row the first right row, in order, with the same address.

    The right side is reduced to its first row per key before the join, so the work stays linear even
    where very many rows share one address.  ``scope`` columns (such as a cluster id) must be equal too.
    Returns the left id columns and ``match``, a struct of the right values; rows without one are absent.
    """
    scope, ids = list(scope), [c for c in left_id if c not in scope]
    by = scope + ["key_kind", "key", "port"]
    order = F.struct(*right_order)
    keep = list(dict.fromkeys([*scope, *right_value, *right_order]))
    firsts = (
        address_keys(right, keep, right_address, hosts)
        .groupBy(*by)
        .agg(F.min(F.struct(order.alias("_order"), F.struct(*right_value).alias("_value"))).alias("_first"))
    )
    found = join_per_key(address_keys(left, scope + ids, left_address, hosts), firsts, by)
    if hosts is None:  # one key a row
        return found.select(*scope, *ids, F.col("_first._value").alias("match"))
    return found.groupBy(*scope, *ids).agg(F.min("_first")["_value"].alias("match"))
