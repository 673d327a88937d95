"""Connection URIs: ``scheme://[user:password@]host[:port],…[/database][?options]``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from muster.functions.address import DEFAULT_PORT

SCHEME = "mongodb"  # fixed value
DEFAULT_DATABASE = "admin"  # fixed value

_SHAPE = r"^([a-zA-Z][a-zA-Z0-9+.-]*)://(?:([^/@]*)@)?([^/?#]*)(?:/([^?#]*))?(?:\?([^#]*))?(?:#.*)?$"


def parse_uri(uri: Column, default_port: int | None = DEFAULT_PORT) -> Column:
    """Struct of scheme, username, password, nodes, database, options; ``parse_url`` cannot read many hosts."""

    def part(group: int) -> Column:
        return F.nullif(F.regexp_extract(uri, _SHAPE, group), F.lit(""))

    login = part(2)

    def decoded(index: int) -> Column:
        return F.try_url_decode(F.get(F.split(login, ":", 2), F.lit(index)))

    def node(text: Column) -> Column:
        port = F.nullif(F.regexp_extract(text, r":(\d+)$", 1), F.lit("")).try_cast("int")
        return F.struct(
            F.regexp_replace(text, r":\d*$", "").alias("host"),
            (F.coalesce(port, F.lit(default_port)) if default_port is not None else port).alias("port"),
        )

    return F.when(
        uri.rlike(_SHAPE),
        F.struct(
            F.lower(part(1)).alias("scheme"),
            decoded(0).alias("username"),
            decoded(1).alias("password"),
            F.transform(F.split(F.regexp_extract(uri, _SHAPE, 3), ","), node).alias("nodes"),
            part(4).alias("database"),
            part(5).alias("options"),
        ),
    )


def is_fleet_uri(uri: Column) -> Column:
    """A URI of the fleet's own scheme whose every node has a host."""
    parsed = parse_uri(uri)
    hosts_set = F.forall(parsed["nodes"], lambda n: F.length(n["host"]) > 0)
    return F.coalesce((parsed["scheme"] == SCHEME) & hosts_set, F.lit(False))


def member_uris(parsed: Column) -> Column:
    """One URI per node: the user kept, the password hidden, the slash always there."""
    login = F.when(parsed["username"].isNotNull(), F.concat(parsed["username"], F.lit(":****@"))).otherwise("")
    tail = F.concat(F.lit("/"), F.coalesce(parsed["database"], F.lit("")))
    return F.transform(
        parsed["nodes"],
        lambda n: F.concat(parsed["scheme"], F.lit("://"), login, F.concat_ws(":", n["host"], n["port"]), tail),
    )


def masked_uri(parsed: Column) -> Column:
    """The URI with user and password hidden, every port written out."""
    hosts = F.array_join(F.transform(parsed["nodes"], lambda n: F.concat_ws(":", n["host"], n["port"])), ",")
    return F.concat(
        parsed["scheme"],
        F.lit("://"),
        F.when(parsed["username"].isNotNull(), "*****:*****@").otherwise(""),
        hosts,
        F.when(parsed["database"].isNotNull(), F.concat(F.lit("/"), parsed["database"])).otherwise(""),
    )
