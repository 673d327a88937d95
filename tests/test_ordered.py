"""Hot groups are cut; the result must equal the plain window over the whole group."""

import json
import random

import pytest
from pyspark.sql import functions as F

from muster.operators import ordered
from muster.operators.health import status_documents
from muster.operators.report import member_listing


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(7)
    out = []
    for i in range(400):
        key = None if i % 11 == 0 else ("hot" if i % 3 == 0 else f"k{rnd.randrange(40)}")
        out.append((key, i, rnd.randrange(100), rnd.random() < 0.2))
    return out


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "g string, o bigint, v bigint, flag boolean").repartition(5).cache()


def split():
    return [ordered.count_pieces(F.col("o"), 37)]


def groups(rows):
    by_key = {}
    for row in sorted(rows, key=lambda r: r[1]):
        by_key.setdefault(row[0], []).append(row)
    return by_key


@pytest.mark.parametrize("hot_rows", [10, 30, 10_000])
def test_position_and_total(table, rows, hot_rows):
    got = {
        r.o: (r.pos, r.total)
        for r in ordered.running_total(
            ordered.with_position(table, ["g"], ["o"], split(), hot_rows=hot_rows),
            ["g"], ["o"], split(), F.col("v"), "total", hot_rows=hot_rows,
        ).collect()
    }
    want = {}
    for group in groups(rows).values():
        total = 0
        for pos, (_, o, v, _) in enumerate(group):
            total += v
            want[o] = (pos, total)
    assert got == want


@pytest.mark.parametrize("hot_rows", [10, 10_000])
@pytest.mark.parametrize("after", [False, True])
@pytest.mark.parametrize("inclusive", [False, True])
def test_nearest(table, rows, hot_rows, after, inclusive):
    found = ordered.nearest(
        table, ["g"], ["o"], split(), [F.col("o").alias("at")], F.col("flag"), "n",
        after=after, inclusive=inclusive, hot_rows=hot_rows,
    )
    got = {r.o: r.n.at if r.n else None for r in found.collect()}
    want = {}
    for group in groups(rows).values():
        for i, row in enumerate(group):
            if after:
                pool = group[i if inclusive else i + 1:]
            else:
                pool = list(reversed(group[: i + 1 if inclusive else i]))
            want[row[1]] = next((r[1] for r in pool if r[3]), None)
    assert got == want


@pytest.mark.parametrize("part_rows", [10, 10_000])
def test_ordered_concat(table, rows, part_rows):
    parts = ordered.ordered_concat(
        table, ["g"], ["o"], split(), F.col("v"), "text", part_rows=part_rows
    ).collect()
    got = {}
    for r in sorted(parts, key=lambda r: r.part):
        got.setdefault(r.g, []).append(r.text)
        assert r.part < r.parts
    assert {k: ",".join(v) for k, v in got.items()} == {
        k: ",".join(str(r[2]) for r in v) for k, v in groups(rows).items()
    }
    assert (max(r.parts for r in parts) > 1) == (part_rows == 10)


def test_pieces_are_bounded(spark):
    """One key, one day, one line: pieces stay near the set number of rows, and positions are right."""
    df = spark.range(20_000).select(F.lit("one").alias("g"), F.lit(7).alias("line"), F.col("id").alias("o"))
    cut, pieces = ordered.cut_hot_groups(df, ["g"], ["line", "o"], [F.col("line")], hot_rows=500)
    assert cut.groupBy(*pieces).count().agg(F.max("count")).first()[0] < 1500
    placed = ordered.with_position(df, ["g"], ["line", "o"], [F.col("line")], hot_rows=500)
    assert placed.where("pos <> o").count() == 0


def test_parts_join_to_the_whole(spark, table, rows):
    """A listing and a status document in parts of 7 members, against the same in one part."""
    groups_table = table.select("g").distinct()
    whole, cut = (
        member_listing(groups_table, "g", table, "g", ["o"], split(), F.col("v"), part_rows=n) for n in (10_000, 7)
    )
    assert _joined(cut, "members", ", ") == _joined(whole, "members", ", ")
    leaders = groups_table.withColumn("leader", F.lit("x"))
    whole, cut = (status_documents(table, leaders, ["g"], ["o"], split(), part_rows=n) for n in (10_000, 7))
    texts = _joined(cut, "status", ",")
    assert texts == _joined(whole, "status", ",")
    assert all(len(json.loads(t)["otherMembers"]) == len(groups(rows)[g]) for g, t in texts.items())


def _joined(df, name, separator):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r.part):
        out.setdefault(r.g, []).append(r[name])
    return {g: separator.join(parts) for g, parts in out.items()}


def test_no_pairs_are_compared(table):
    plan = ordered.with_position(table, ["g"], ["o"], split(), hot_rows=10)._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "CartesianProduct" not in plan
