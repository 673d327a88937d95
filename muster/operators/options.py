"""Command options: gating by version or role, and rendering.

Options are kept as ``map<string,string>``, or as ``map<string,variant>`` where the type of a value counts: only there can the text
``"0"`` be told from the number 0.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import VariantType

from muster.functions.versions import key_at_least, version_key
from muster.operators.layers import merge_settings


@dataclass(frozen=True)
class Gate:
    """Drop an option below a version, or add one from a version on unless it (or ``unless``) is set."""

    option: str
    below: str | None = None
    since: str | None = None
    value: str = "true"
    unless: str | None = None


# fixed values
EXPORT_GATES = (Gate("authenticationDatabase", below="2.4.0"), Gate("dumpDbUsersAndRoles", below="2.6.0"))
IMPORT_GATES = (
    Gate("authenticationDatabase", below="2.4.0"),
    Gate("restoreDbUsersAndRoles", below="2.6.0"),
    Gate("writeConcern", since="3.0.0", value="{w:1}"),
    Gate("stopOnError", since="3.0.0", unless="continueOnError"),
)
STANDALONE_DROPS = ("replSet", "keyFile")
FALSY = ("", "false", "0", "0.0", "[]", "{}")


def with_option(options: Column, name: str, value: Column | str) -> Column:
    extra = F.create_map(F.lit(name), F.lit(value) if isinstance(value, str) else value)
    return merge_settings(options, extra)


def _apply(options: Column, drops: dict[str, Column], adds: dict[str, tuple[Column, Column | str]]) -> Column:
    """Drop and add options in one pass; an added option never replaces one that is there.

    ``drops`` maps a name to the condition to drop it, ``adds`` a name to (condition, value).  Dropping
    also undoes an addition.  Options without a value (null) are left out.
    """
    no, nothing = F.lit(False), (F.lit(False), "")

    def change(name: str) -> Column:
        when, value = adds.get(name, nothing)
        text = F.lit(value) if isinstance(value, str) else value.cast("string")
        return F.struct(
            F.coalesce(drops.get(name, no), no).alias("drop"), F.when(F.coalesce(when, no), text).alias("value")
        )

    names = list(dict.fromkeys([*drops, *adds]))
    # both maps are arguments of the zip, so their conditions are worked out once per row
    changes = F.create_map(*[c for n in names for c in (F.lit(n), change(n))])
    merged = F.map_zip_with(
        options,
        changes,
        lambda k, old, new: F.when(new["drop"], F.lit(None).cast("string")).otherwise(F.coalesce(old, new["value"])),
    )
    return F.map_filter(merged, lambda k, v: v.isNotNull())


def gate_options(
    df: DataFrame, options: str, version: str, gates: Sequence[Gate], name: str | None = None
) -> DataFrame:
    """Apply the gates to each row's options; an unknown version (null) passes everything through."""
    current = F.col(options)

    def given(gate: Gate) -> Column:
        names = [gate.option] + ([gate.unless] if gate.unless else [])
        return F.exists(F.map_keys(current), lambda k: k.isin(*names))

    key = F.col("_version_key")
    drops = {g.option: ~key_at_least(key, g.below) for g in gates if g.below is not None}
    adds = {
        g.option: (key_at_least(key, g.since) & ~given(g), g.value) for g in gates if g.since is not None
    }
    return (
        df.withColumn("_version_key", version_key(F.col(version)))
        .withColumn(name or options, _apply(current, drops, adds))
        .drop("_version_key")
    )


def role_options(
    df: DataFrame,
    options: str,
    replica_set: Column | None = None,
    standalone: Column | None = None,
    config_server: Column | None = None,
    shard_server: Column | None = None,
    name: str | None = None,
) -> DataFrame:
    """Options that follow from a server's role; a cache size that is no whole number is dropped."""
    no = F.lit(False)
    current = F.col(options)
    adds: dict[str, tuple[Column, Column | str]] = {}
    if replica_set is not None:
        adds["replSet"] = (replica_set.isNotNull(), replica_set)
    if config_server is not None:
        adds["configsvr"] = (config_server, "true")
    if shard_server is not None:
        adds["shardsvr"] = (shard_server, "true")
    drops = {k: standalone for k in STANDALONE_DROPS} if standalone is not None else {}
    cache = F.try_element_at(current, F.lit("wiredTigerCacheSizeGB"))
    drops["wiredTigerCacheSizeGB"] = ~F.coalesce(cache.rlike(r"^-?[0-9]+$"), no)
    return df.withColumn(name or options, _apply(current, drops, adds))


def option_arguments(options: Column, allowed: Sequence[str] | None = None) -> Column:
    """Arguments in name order: a bare flag for true, one pair per list element, else name and value.

    Values that are false, zero or empty are left out.
    """
    kept = F.map_filter(
        options,
        lambda k, v: v.isNotNull() & ~v.isin(*FALSY) & (k.isin(*allowed) if allowed is not None else F.lit(True)),
    )

    def render(entry: Column) -> Column:
        flag = F.concat(F.lit("--"), entry["key"])
        items = F.from_json(entry["value"], "array<string>")
        return (
            F.when(entry["value"] == "true", F.array(flag))
            .when(
                entry["value"].startswith("["),
                F.flatten(F.transform(items, lambda item: F.array(flag, item))),
            )
            .otherwise(F.array(flag, entry["value"]))
        )

    return F.flatten(F.transform(F.sort_array(F.map_entries(kept)), render))


def typed_arguments(options: Column, allowed: Sequence[str] | None = None) -> Column:
    """``option_arguments`` of typed values: false, zero, null and what is empty go; the texts "0", "false" and "true" are texts."""
    def kind(value: Column) -> Column:
        return F.substring_index(F.substring_index(F.schema_of_variant(value), "<", 1), "(", 1)

    def text(value: Column) -> Column:
        return F.variant_get(value, "$", "string")

    def empty(value: Column) -> Column:
        return (
            F.when(kind(value) == "BOOLEAN", text(value) == "false")
            .when(kind(value).isin("BIGINT", "DOUBLE", "FLOAT", "DECIMAL"), F.try_variant_get(value, "$", "double") == 0)
            .otherwise(F.to_json(value).isin('""', "[]", "{}"))
        )

    names = [k for k in sorted(allowed)] if allowed is not None else None
    kept = F.map_filter(options, lambda k, v: ~F.coalesce(F.is_variant_null(v), F.lit(True)) & (k.isin(*names) if names else F.lit(True)))

    def render(key: Column) -> Column:
        value, flag = F.try_element_at(kept, key), F.concat(F.lit("--"), key)
        items = F.try_variant_get(value, "$", "array<variant>")
        return (
            F.when(empty(value), F.expr("cast(array() as array<string>)"))
            .when(kind(value) == "BOOLEAN", F.array(flag))
            .when(kind(value) == "ARRAY", F.flatten(F.transform(items, lambda item: F.array(flag, text(item)))))
            .when(kind(value) == "OBJECT", F.array(flag, F.to_json(value)))
            .otherwise(F.array(flag, text(value)))
        )

    return F.flatten(F.transform(F.sort_array(F.map_keys(kept)), render))


def option_inventory(df: DataFrame, options: str, keep: Sequence[str], allowed: Sequence[str] | None = None) -> DataFrame:
    """The rendered options of each row as one text, and how many words it has."""
    typed = isinstance(df.schema[options].dataType.valueType, VariantType)
    arguments = (typed_arguments if typed else option_arguments)(F.col(options), allowed)
    return df.select(*keep, F.array_join(arguments, " ").alias("arguments"), F.size(arguments).alias("words"))


def option_usage(df: DataFrame, options: str) -> DataFrame:
    """Across all rows: how often each option is set, and to how many values."""
    long = df.select(F.explode(options).alias("option", "value"))
    return long.groupBy("option").agg(
        F.count(F.lit(1)).alias("uses"), F.approx_count_distinct("value").alias("values")
    )
