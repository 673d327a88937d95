"""Log text: parsing, attaching continuation lines, the last lines of each log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.operators.lookup import top_rows
from muster.operators.ordered import count_pieces, nearest, with_position
from muster.operators.skew import HOT_ROWS
from muster.session import materialise

# fixed values: "   LEVEL | 2024-01-01 00:00:00,123 | message", and how many lines a tail shows
LINE = r"^ *([A-Z]+) \| (\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3}) \| (.*)$"
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss,SSS"
TAIL_LINES = 15


def header_columns(line: Column) -> dict[str, Column]:
    """Level, time and message of a line that starts a record; nulls for any other line."""
    starts = line.rlike(LINE)

    def part(group: int) -> Column:
        return F.when(starts, F.regexp_extract(line, LINE, group))

    return {"level": part(1), "ts": F.try_to_timestamp(part(2), F.lit(TIME_FORMAT)), "message": part(3)}


def format_line(level: Column, ts: Column, message: Column) -> Column:
    """A log line in the form ``header_columns`` reads."""
    return F.concat(F.lpad(level, 8, " "), F.lit(" | "), F.date_format(ts, TIME_FORMAT), F.lit(" | "), message)


def log_line_columns() -> list[Column]:
    """What a text scan has to give for its lines to be numbered."""
    return [
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value")
    ]


def number_lines(scanned: DataFrame) -> DataFrame:
    """``file, line, value``: the lines of a text scan numbered from 0 in each file.

    A split of a file is read by one task in order, so the split's start and the order inside the task place a line; the
    order is written down before it is used.  A long file is numbered split by split.
    """
    placed = materialise(scanned.withColumn("at", F.monotonically_increasing_id()), "lines")
    return with_position(placed, ["file"], ["block", "at"], [F.col("block")], "line").select("file", "line", "value")


def read_log(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Every line of log files with the record it belongs to; see ``parse_log``."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    return parse_log(number_lines(spark.read.text(paths).select(*log_line_columns())))


def parse_log(
    lines: DataFrame,
    file: str = "file",
    line: str = "line",
    value: str = "value",
    piece_lines: int = 100_000,
    hot_rows: int = HOT_ROWS,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Every line with the level, time and line number of the record it belongs to.

    A line that does not look like the start of a record continues the last one (a traceback, say); lines
    before the first record have nulls.  ``hot`` may name the very long logs, from ``hot_groups``.
    """
    parsed = lines.withColumns(header_columns(F.col(value)))
    starts = F.col("level").isNotNull()
    placed = nearest(
        parsed,
        [file],
        [line],
        [count_pieces(F.col(line), piece_lines)],
        [F.col(line).alias("record"), F.col("level"), F.col("ts")],
        starts,
        "_head",
        inclusive=True,
        hot_rows=hot_rows,
        hot=hot,
    )
    return placed.select(
        file,
        line,
        F.col("_head.record").alias("record"),
        F.col("_head.level").alias("level"),
        F.col("_head.ts").alias("ts"),
        F.coalesce("message", value).alias("message"),
        (~starts).alias("continued"),
    )


def tail(df: DataFrame, group: Sequence[str], order: Sequence[str], n: int = TAIL_LINES) -> DataFrame:
    """The last ``n`` rows of each group, cut to ``n`` per map task before the shuffle."""
    return top_rows(df, group, [F.col(c).desc() for c in order], n)
