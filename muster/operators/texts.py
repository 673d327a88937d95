"""Whole-corpus text jobs: masking and URI tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.functions.address import is_member_address
from muster.functions.text import MASKING_RULES, mask
from muster.functions.uris import DEFAULT_DATABASE, is_fleet_uri, masked_uri, member_uris, parse_uri


def redact(
    df: DataFrame, text: str, rules: dict[str, tuple[str, str]] | None = None, name: str = "redacted"
) -> DataFrame:
    """Mask every hit of every rule in the whole text; ``hits_<rule>`` counts what each rule found."""
    rules = rules or MASKING_RULES
    counts = {f"hits_{k}": F.regexp_count(F.col(text), F.lit(p)).cast("bigint") for k, (p, _) in rules.items()}
    return df.withColumns({name: mask(F.col(text), rules), **counts})


def redaction_totals(redacted: DataFrame, rules: Sequence[str]) -> DataFrame:
    """Hits and affected rows per rule, in one pass."""
    pairs = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"hits_{r}").alias("hits")) for r in rules])
    return (
        redacted.select(F.inline(pairs))
        .groupBy("rule")
        .agg(F.sum("hits").alias("hits"), F.count_if(F.col("hits") > 0).alias("rows"))
    )


def parse_uris(df: DataFrame, uri: str, default_port: int | None = 27017) -> DataFrame:
    """Add the parts of a URI: credentials, database, the number of nodes, whether it names a cluster."""
    parsed = df.withColumn("_u", parse_uri(F.col(uri), default_port))
    no_host = F.exists("_u.nodes", lambda n: F.length(n["host"]) == 0)
    error = F.when(F.col("_u").isNull(), "malformed").when(no_host, "missing host")
    return parsed.select(
        *df.columns,
        F.col("_u.scheme").alias("scheme"),
        F.col("_u.username").alias("username"),
        F.col("_u.password").alias("password"),
        F.col("_u.nodes").alias("nodes"),
        F.coalesce("_u.database", F.when(F.col("_u").isNotNull(), F.lit(DEFAULT_DATABASE))).alias("database"),
        (F.size("_u.nodes") > 1).alias("is_cluster"),
        masked_uri(F.col("_u")).alias("masked"),
        error.alias("error"),
    )


def uri_nodes(parsed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per node, in URI order: the member list of a cluster built from a URI."""
    return parsed.where(F.col("error").isNull()).select(
        *keys, F.posexplode("nodes").alias("pos", "_n")
    ).select(*keys, F.col("pos").cast("bigint").alias("pos"), F.concat_ws(":", "_n.host", "_n.port").alias("host"))


def uris_per_member(df: DataFrame, uri: str, keys: Sequence[str], default_port: int | None = 27017) -> DataFrame:
    """A masked URI for each node of each well-formed URI, in URI order."""
    parsed = df.select(*keys, parse_uri(F.col(uri), default_port).alias("_u")).where(F.col("_u").isNotNull())
    return parsed.select(*keys, F.posexplode(member_uris(F.col("_u"))).alias("pos", "member_uri")).withColumn(
        "pos", F.col("pos").cast("bigint")
    )


def looks_like_address(value: Column) -> Column:
    return is_fleet_uri(value) | is_member_address(value)
