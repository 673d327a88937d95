"""Columns over times and durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(ts: Column) -> Column:
    """Microseconds since the epoch; zone-less timestamps are read in the session time zone."""
    return F.unix_micros(ts.cast("timestamp"))


def seconds_between(later: Column, earlier: Column) -> Column:
    """Signed difference as a float number of seconds."""
    return (micros(later) - micros(earlier)) / F.lit(1e6)


def humanise_seconds(seconds: Column) -> Column:
    """``D day(s) H hour(s) M minute(s) S second(s)``: leading zero units dropped, inner ones kept."""
    whole = F.floor(seconds).cast("bigint")

    def unit(size: int, wrap: int | None) -> Column:
        count = F.floor(whole / F.lit(size)).cast("bigint")
        return count % F.lit(wrap) if wrap else count

    return F.concat_ws(
        " ",
        F.when(whole >= 86400, F.format_string("%d day(s)", unit(86400, None))),
        F.when(whole >= 3600, F.format_string("%d hour(s)", unit(3600, 24))),
        F.when(whole >= 60, F.format_string("%d minute(s)", unit(60, 60))),
        F.when(seconds.isNotNull(), F.format_string("%d second(s)", whole % F.lit(60))),
    )
