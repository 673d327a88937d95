"""Version matching, editions and artifact names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.functions.versions import (
    COMMUNITY,
    COMMUNITY_SSL,
    EDITIONS,
    ENTERPRISE,
    edition_of,
    key_at_least,
    version_key,
)
from muster.operators.skew import join_per_key

EXACT, MAJOR_GE, LATEST_STABLE = "EXACT", "MAJOR_GE", "LATEST_STABLE"
EXACT_OR_MINOR, LATEST_MINOR, DEFAULT = "EXACT_OR_MINOR", "LATEST_MINOR", "DEFAULT"


def _keyed(installs: DataFrame, path: str, version: str, edition: str) -> DataFrame:
    return installs.select(
        F.col(path).alias("_path"),
        F.col(version).alias("_version"),
        edition_of(F.col(edition)).alias("_edition"),
        version_key(F.col(version)).alias("_key"),
    ).where(F.col("_key").isNotNull())


def _lines(versions: DataFrame) -> DataFrame:
    """The index: a row per edition, major and minor number, with the best install and that of every version.

    A row holds the versions released of one line, however many installs there are of them.
    """
    # numbers that the planner knows to be there: a filter of the join's own would need a scan of its own
    numbers = [F.coalesce(F.col(f"_key.{c}"), F.lit(0)).alias(f"_{c}") for c in ("major", "minor")]
    return versions.groupBy("_edition", *numbers).agg(
        F.max_by("_hit", "_key").alias("_near"),
        F.map_from_entries(F.collect_list(F.struct("_key", "_hit"))).alias("_each"),
    )


def match_versions(
    requests: DataFrame,
    installs: DataFrame,
    preference: str,
    version: str = "version",
    edition: str = "edition",
    path: str = "path",
    installed_version: str = "version",
    installed_edition: str = "edition",
) -> DataFrame:
    """The install chosen for each request: ``match_path``, ``match_version``, ``match_edition``.

    Always the highest that fits.  A request without a version takes the latest stable install, or the
    latest of all where none is stable, whatever the preference.

    Installs are reduced once, to one row per edition and version with the first path among equals; all that
    a preference looks at comes from there, and requests meet it in one join at most.
    """
    found = _keyed(installs, path, installed_version, installed_edition)
    versions = found.groupBy("_edition", "_key").agg(F.min(F.struct("_path", "_version", "_edition")).alias("_hit"))
    # best of the whole table, whatever the edition
    rank = F.struct((F.col("_key.minor") % 2 == 0).alias("stable"), F.col("_key").alias("key"))
    per_key = versions.groupBy("_key").agg(F.min("_hit").alias("_hit"))
    overall = per_key.agg(
        F.max_by("_hit", rank).alias("_default"),
        F.max_by(F.when(F.col("_key.minor") % 2 == 0, F.col("_hit")), rank).alias("_stable"),
    ).withColumn("_any", F.lit(1))
    # a global aggregate is exactly one row, so it is safe to broadcast
    asked = requests.withColumns(
        {"_asked": version_key(F.col(version)), "_edition": edition_of(F.col(edition))}
    )
    out = asked.join(F.broadcast(overall), F.col("_any") == F.lit(1), "left").drop("_any")

    choice: Column
    if preference in (EXACT, EXACT_OR_MINOR, LATEST_MINOR):
        numbers = {"_major": F.col("_asked.major"), "_minor": F.col("_asked.minor")}
        out = join_per_key(out.withColumns(numbers), _lines(versions), ["_edition", "_major", "_minor"], "left")
        exact = F.try_element_at("_each", F.col("_asked"))
        choice = {EXACT: exact, LATEST_MINOR: F.col("_near"), EXACT_OR_MINOR: F.coalesce(exact, "_near")}[preference]
    elif preference == MAJOR_GE:
        # the highest of an edition fits exactly when any of them does
        highest = versions.groupBy("_edition").agg(F.max_by("_hit", "_key").alias("_near"), F.max("_key").alias("_top"))
        out = join_per_key(out, highest, ["_edition"], "left")
        choice = F.when(F.col("_top.major") >= F.col("_asked.major"), F.col("_near"))
    elif preference == LATEST_STABLE:
        choice = F.col("_stable")
    else:
        choice = F.col("_default")
    picked = F.when(F.col(version).isNull(), F.col("_default")).otherwise(choice)
    return (
        out.withColumn("_picked", picked)
        .withColumns(
            {
                "match_path": F.col("_picked._path"),
                "match_version": F.col("_picked._version"),
                "match_edition": F.col("_picked._edition"),
            }
        )
        .select(*requests.columns, "match_path", "match_version", "match_edition")
    )


def restore_request(version: Column) -> tuple[Column, Column]:
    """Version and preference to use for a restore: 3.0.7 needs exactly 3.0.6."""
    avoided = F.coalesce(version_key(version) == version_key(F.lit("3.0.7")), F.lit(False))
    return (
        F.when(avoided, "3.0.6").otherwise(version),
        F.when(avoided, EXACT).otherwise(EXACT_OR_MINOR),
    )


def edition_from_build(git_version: Column, openssl_version: Column, openssl_running: Column) -> Column:
    """Edition by build information."""
    enterprise = git_version.contains("subscription") | git_version.contains("enterprise")
    ssl = (F.coalesce(openssl_version, F.lit("")) != "") | (openssl_running != "disabled")
    return (
        F.when(F.coalesce(enterprise, F.lit(False)), ENTERPRISE)
        .when(F.coalesce(ssl, F.lit(False)), COMMUNITY_SSL)
        .otherwise(COMMUNITY)
    )


def edition_from_output(version_output: Column, help_output: Column) -> Column:
    """Edition by what the program prints."""
    enterprise = version_output.contains("subscription") | version_output.contains("enterprise")
    return (
        F.when(F.coalesce(enterprise, F.lit(False)), ENTERPRISE)
        .when(F.coalesce(help_output.contains("SSL"), F.lit(False)), COMMUNITY_SSL)
        .otherwise(COMMUNITY)
    )


def version_inventory(installs: DataFrame, version: str, edition: str, path: str) -> DataFrame:
    """How many installs there are of each version and edition, and the first location."""
    return installs.groupBy(version, edition).agg(
        F.count(F.lit(1)).alias("installs"), F.min(path).alias("first_location")
    )


def storage_default(df: DataFrame, version: str, engine: Column, name: str = "newer_engine") -> DataFrame:
    """Whether the newer storage engine is in use; null before 3.0."""
    key = F.col("_version_key")
    chosen = F.coalesce(engine == "wiredTiger", F.lit(False))
    unset = F.coalesce(engine, F.lit("")) == ""
    used = F.when(key_at_least(key, "3.2.0"), unset | chosen).when(key_at_least(key, "3.0.0"), chosen)
    return df.withColumn("_version_key", version_key(F.col(version))).withColumn(name, used).drop("_version_key")


def platform_spec(os_name: Column, bits: Column, edition: Column) -> Column:
    """Platform part of an artifact name; null for an operating system that is not supported."""
    wide = F.when((os_name == "osx") & (edition == COMMUNITY_SSL), "osx-ssl-x86_64").otherwise(
        F.concat(os_name, F.lit("-x86_64"))
    )
    narrow = (
        F.when(os_name == "linux", "linux-i686")
        .when(os_name.isin("osx", "win32"), F.concat(os_name, F.lit("-i386")))
        .when(os_name == "sunos5", "i86pc")
    )
    return F.when(
        os_name.isin("linux", "osx", "win32", "sunos5"), F.when(bits == "64", wide).otherwise(narrow)
    )


def artifact_url(
    version: Column,
    key: Column,
    edition: Column,
    os_name: Column,
    bits: Column,
    dist: Column,
    dist_version: Column,
) -> Column:
    """Where an artifact is found, by version text and version key; null where none exists."""
    spec = platform_spec(os_name, bits, edition)
    plain_dist = F.concat(dist, F.replace(dist_version, F.lit("."), F.lit("")))
    tail = F.concat(F.lit("-"), version, F.lit(".tgz"))
    optional_dist = F.when(dist.isNotNull(), F.concat(F.lit("-"), plain_dist)).otherwise("")
    modern = key_at_least(key, "2.6.1")
    # fixed values: hosts and names by edition and version
    name = (
        F.when(edition == COMMUNITY, F.concat(F.lit("mongodb-"), spec, tail))
        .when(
            (edition == COMMUNITY_SSL) & key_at_least(key, "3.0"),
            F.concat(F.lit("mongodb-"), spec, optional_dist, tail),
        )
        .when(
            edition == ENTERPRISE,
            F.concat(
                F.lit("mongodb-"),
                spec,
                F.when(modern, "-enterprise-").otherwise("-subscription-"),
                plain_dist,
                tail,
            ),
        )
    )
    domain = F.when(
        edition == ENTERPRISE, F.when(modern, "downloads.10gen.com").otherwise("downloads.mongodb.com")
    ).otherwise("fastdl.mongodb.org")
    return F.concat(F.lit("http://"), domain, F.lit("/"), os_name, F.lit("/"), name)


def artifact_catalog(
    versions: DataFrame,
    platforms: Sequence[tuple[str, str, str | None, str | None]],
    editions: Sequence[str] = tuple(EDITIONS),
    version: str = "version",
) -> DataFrame:
    """Every artifact there is of every version, one row per platform and edition.

    ``platforms`` lists ``(os_name, bits, dist, dist_version)``.  The list is part of the plan, so each
    version is expanded where it is read: no join and no shuffle.
    """

    def target(os_name: str, bits: str, dist: str | None, dist_version: str | None, edition: str) -> Column:
        return F.struct(
            F.lit(os_name).alias("os_name"),
            F.lit(bits).alias("bits"),
            F.lit(dist).cast("string").alias("dist"),
            F.lit(dist_version).cast("string").alias("dist_version"),
            F.lit(edition).alias("edition"),
        )

    targets = F.array(*[target(*p, e) for p in platforms for e in editions])
    url = artifact_url(
        F.col(version), F.col("_version_key"), F.col("edition"), F.col("os_name"), F.col("bits"), F.col("dist"),
        F.col("dist_version"),
    )
    return (
        versions.withColumn("_version_key", version_key(F.col(version)))
        .select("*", F.explode(targets).alias("_t"))
        .select(*versions.columns, "_version_key", "_t.*")
        .withColumn("url", url)
        .drop("_version_key")
        .where(F.col("url").isNotNull())
        .withColumn("archive", F.try_element_at(F.split("url", "/"), F.lit(-1)))
    )


def install_folder(spec: Column, edition: Column, version: Column) -> Column:
    return F.concat_ws("-", F.lit("mongodb"), spec, edition, version)
