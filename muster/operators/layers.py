"""Layered catalogs and settings maps."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def layer_documents(layers: Sequence[DataFrame], key: str, seq: str | None = None) -> DataFrame:
    """One document per key out of several layers, the last layer winning over the earlier ones.

    Pass files first, then inline documents, then the stored ones.  ``seq`` orders the duplicates inside
    one layer; the later one wins.  Documents are reduced before the shuffle, so a key that fills a
    third of the input reaches its reducer as one row per map task.
    """
    order = F.col(seq).cast("bigint") if seq else F.lit(0).cast("bigint")
    stacked = reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True),
        [layer.withColumn("_at", F.struct(F.lit(i).alias("layer"), order.alias("seq"))) for i, layer in enumerate(layers)],
    )
    columns = [c for c in stacked.columns if c not in ("_at", key)]
    winner = F.max_by(F.struct(*columns, F.col("_at.layer").alias("layer")), "_at").alias("_doc")
    return stacked.groupBy(key).agg(winner).select(key, "_doc.*")


def _empty_settings() -> Column:
    return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))


def merge_settings(current: Column, declared: Column) -> Column:
    """Declared settings laid over current ones; null where nothing is declared.

    Declared values are wrapped before the maps are zipped, so that one declared as null still wins.
    """
    wrapped = F.transform_values(declared, lambda k, v: F.struct(v.alias("v")))
    merged = F.map_zip_with(
        F.coalesce(current, _empty_settings()),
        wrapped,
        lambda k, old, new: F.when(new.isNotNull(), new["v"]).otherwise(old),
    )
    return F.when(F.size(declared) > 0, merged)


def override_options(options: Column, override: Column) -> Column:
    """As a map update: the override wins, and either side may be missing."""
    return F.coalesce(merge_settings(options, override), options)


def settings_text(settings: Column) -> Column:
    """``k=v`` pairs sorted by key, for display and comparison."""
    pairs = F.sort_array(F.map_entries(settings))
    return F.array_join(
        F.transform(pairs, lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))), ","
    )
