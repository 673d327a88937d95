"""Version numbers as a sortable struct."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
COMMUNITY, COMMUNITY_SSL, ENTERPRISE = "community", "community_ssl", "enterprise"
EDITIONS = [COMMUNITY, COMMUNITY_SSL, ENTERPRISE]
MINIMUM_VERSION = "1.8"

# numbers, then an optional stage (with or without its own number), then an optional build count
_SHAPE = (
    r"^v?(\d{1,9})\.(\d{1,9})(?:\.(\d{1,9}))?(?:\.(\d{1,9}))?"
    r"(?:[-._~]?(alpha|beta|preview|pre|rc|a|b|c)[-._]?(\d{0,9}))?"
    r"(?:-(\d{1,9}))?$"
)


_FIELDS = ["major", "minor", "patch", "build", "stage", "stage_no", "post"]
_MARK = "\x01"


def version_key(version: Column) -> Column:
    """Struct that orders versions field by field, or null where the text is no version.

    A pre-release sorts before its release.  The edition is no part of the key: compare it apart.
    One pass of the pattern rewrites the text to its marked parts.  Put the key in a column where more
    than one comparison needs it.
    """
    text = F.lower(F.replace(F.trim(version), F.lit("-pre-"), F.lit("-pre")))
    marked = F.regexp_replace(text, _SHAPE, _MARK.join(["0$1", "0$2", "0$3", "0$4", "$5", "0$6", "0$7"]))

    def key(parts: Column) -> Column:
        stage = parts[4]
        rank = (
            F.when(stage == "", 3)
            .when(stage.isin("alpha", "a"), 0)
            .when(stage.isin("beta", "b"), 1)
            .otherwise(2)
        )
        fields = [rank if f == "stage" else parts[i].cast("int") for i, f in enumerate(_FIELDS)]
        return F.when(F.size(parts) == 7, F.struct(*[c.alias(f) for c, f in zip(fields, _FIELDS)]))

    # the one-element array names the parts, so the pattern runs once per row
    return F.transform(F.array(F.split(marked, _MARK)), key)[0]


def bound_key(bound: str) -> Column:
    """Key of a released version given as plain numbers, made of literals."""
    numbers = [int(n) for n in bound.split(".")]
    values = (numbers + [0] * 4)[:4] + [3, 0, 0]
    return F.struct(*[F.lit(v).alias(f) for v, f in zip(values, _FIELDS)])


def key_at_least(key: Column, bound: str) -> Column:
    return key >= bound_key(bound)


def at_least(version: Column, bound: str) -> Column:
    """Null where the version is null or malformed."""
    return key_at_least(version_key(version), bound)


def is_valid(version: Column, edition: Column | None = None) -> Column:
    known = F.lit(True) if edition is None else F.coalesce(edition, F.lit(COMMUNITY)).isin(EDITIONS)
    return version_key(version).isNotNull() & known


def is_supported(version: Column) -> Column:
    return F.coalesce(at_least(version, MINIMUM_VERSION), F.lit(False))


def edition_of(edition: Column) -> Column:
    return F.coalesce(edition, F.lit(COMMUNITY))
