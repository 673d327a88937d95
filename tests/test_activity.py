"""Snapshots, change logs and activity."""

import random

import pytest
from pyspark.sql import functions as F

from muster.operators import activity as act
from muster.sources import activity as source
from muster.sources import snapshots


def ts(micros_col):
    return F.timestamp_micros(micros_col)


@pytest.fixture(scope="module")
def records():
    """One server has a third of all records; many share a time."""
    rnd, rows = random.Random(3), []
    for i in range(300):
        rows.append(("hot" if i % 3 == 0 else f"s{rnd.randrange(12)}", rnd.randrange(200) * 1_000_000, i, rnd.choice(["start", "stop", "view"])))
    return sorted(rows, key=lambda r: (r[1], r[2]))


@pytest.fixture(scope="module")
def table(spark, records):
    return spark.createDataFrame(records, "server string, us bigint, seq bigint, op string").withColumn("ts", ts(F.col("us"))).cache()


def plain_intervals(records):
    want, by_server = set(), {}
    for server, us, seq, op in records:
        if op != "view":
            by_server.setdefault(server, []).append((us, seq, op))
    for server, rows in by_server.items():
        for i, (us, seq, op) in enumerate(rows):
            if op == "start":
                following = rows[i + 1] if i + 1 < len(rows) else None
                want.add((server, us, seq, following[0] if following and following[2] == "stop" else None, following is None))
    return want


def as_set(df):
    rows = df.select("server", F.unix_micros("started").alias("a"), "started_seq", F.unix_micros("stopped").alias("b"), "pending")
    return {tuple(r) for r in rows.collect()}


@pytest.mark.parametrize("hot_rows", [20, 10_000])
def test_intervals(table, records, hot_rows):
    out = act.lifecycle_intervals(table, "server", "ts", "seq", "op", piece_seconds=7, hot_rows=hot_rows)
    assert as_set(out) == plain_intervals(records)


@pytest.mark.parametrize("hot_rows", [20, 10_000])
def test_await(table, records, hot_rows):
    asked, told = table.where("op = 'start'"), table.where("op = 'stop'")
    out = act.await_outcome(asked, told, ["server"], "ts", "ts", 5, ["seq"], piece_seconds=7, hot_rows=hot_rows)
    got = {(r.seq, r.c, r.met) for r in out.select("seq", F.unix_micros("confirmed").alias("c"), "met").collect()}
    want = set()
    for server, us, seq, op in records:
        if op == "start":
            hits = [u for s, u, _, o in records if s == server and o == "stop" and us < u <= us + 5_000_000]
            want.add((seq, min(hits) if hits else None, bool(hits)))
    assert got == want


def test_activity_is_appended_by_day(spark, table, tmp_path):
    path = str(tmp_path / "activity")
    rows = source.activity_records(table, "op", "ts", "server")
    source.record_activity(rows, path)
    source.record_activity(rows, path)
    source.record_activity(rows, path, enabled=False)
    back = source.read_activity(spark, path)
    assert back.count() == 600 and back.where("dt = '1970-01-01'").count() == 600
    assert "PartitionFilters: [isnotnull(dt" in back.where("dt = '1970-01-01'")._jdf.queryExecution().toString()


def test_snapshot_roundtrip(spark, table, tmp_path):
    src, dest, bad = (str(tmp_path / n) for n in ("src", "dest", "bad"))
    manifest = snapshots.export_snapshot(table, src, {"$or": [{"op": "start"}, {"server": "hot"}]}, ["op"])
    want = table.where("op = 'start' OR server = 'hot'")
    assert {(r.op, r.rows) for r in manifest.collect()} == {(r.op, r["count"]) for r in want.groupBy("op").count().collect()}
    snapshots.import_snapshot(spark, src, dest, schema="server string, us bigint, seq bigint, op string")
    columns = ["server", "us", "seq", "op"]
    assert sorted(map(tuple, spark.read.parquet(dest).select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))
    snapshots.import_snapshot(spark, src, dest, where={"op": "start"}, drop=True)
    assert spark.read.parquet(dest).select("op").distinct().collect()[0].op == "start"

    with pytest.raises(ValueError, match="nothing"):
        snapshots.import_snapshot(spark, src, dest, schema="nothing string")
    with pytest.raises(Exception, match="rejected row"):
        snapshots.import_snapshot(spark, src, str(tmp_path / "stopped"), check=F.col("server") != "hot")
    kept = str(tmp_path / "kept")
    snapshots.import_snapshot(spark, src, kept, check=F.col("server") != "hot", stop_on_error=False, rejects=bad)
    assert spark.read.parquet(kept).count() + spark.read.parquet(bad).count() == want.count()
    assert spark.read.parquet(bad).select("server").distinct().collect()[0].server == "hot"


def test_an_import_is_published_whole_or_not_at_all(spark, table, tmp_path, monkeypatch):
    """A failure between the write and the publication leaves the destination as it was; the repeated load comes once."""
    src, dest, bad = (str(tmp_path / n) for n in ("src", "dest", "bad"))
    snapshots.export_snapshot(table, src)
    snapshots.import_snapshot(spark, src, dest, where={"op": "view"}, load_id="before")
    before = sorted(map(str, spark.read.parquet(dest).collect()))
    moved, real = [], snapshots.move_folder

    def broken(spark, path, to):
        if len(moved) == broken.stop:
            raise OSError("lost")
        moved.append(to)
        real(spark, path, to)

    def load():
        snapshots.import_snapshot(
            spark, src, dest, check=F.col("server") != "hot", stop_on_error=False, rejects=bad, load_id="L1")

    monkeypatch.setattr(snapshots, "move_folder", broken)
    for broken.stop in (0, 1):  # before the rejected rows are published, and between them and the others
        moved.clear()
        with pytest.raises(OSError):
            load()
        assert sorted(map(str, spark.read.parquet(dest).collect())) == before
    monkeypatch.setattr(snapshots, "move_folder", real)
    for _ in range(3):
        load()
    loaded, rejected = spark.read.parquet(dest).where("load = 'L1'"), spark.read.parquet(bad)
    assert loaded.where("server = 'hot'").isEmpty() and rejected.where("server <> 'hot'").isEmpty()
    assert loaded.count() + rejected.count() == table.count()
    assert spark.read.parquet(dest).where("load = 'before'").count() == len(before)
    assert not list(tmp_path.rglob(".staged*"))
    snapshots.import_snapshot(spark, src, dest, drop=True, load_id="L2")
    assert [r.load for r in spark.read.parquet(dest).select("load").distinct().collect()] == ["L2"]


def test_replay(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "k string, v int")
    log = spark.createDataFrame(
        [("a", "upsert", 1, 1, 10), ("a", "delete", 1, 2, None), ("b", "delete", 1, 3, None), ("b", "upsert", 2, 4, 20),
         ("d", "upsert", 1, 5, 40), ("c", "delete", 9, 6, None)], "k string, op string, t int, seq int, v int")
    def state(b, until):
        out = snapshots.replay_changes(b, log, "k", "op", ["t", "seq"], ["v"], F.col("t") <= until)
        return {r.k: r.v for r in out.collect()}

    assert state(base, 5) == {"b": 20, "c": 3, "d": 40}
    assert state(base, 9) == {"b": 20, "d": 40}
    assert state(base, 0) == {"a": 1, "b": 2, "c": 3}
    assert state(None, 5) == {"b": 20, "d": 40}


@pytest.mark.parametrize("values", [3, 40])
def test_export_does_not_sort_what_lies_by_partition(spark, tmp_path, monkeypatch, values):
    """Each writer sorted all its rows; now files stay open side by side, and more of them than may be open lose no row."""
    from pyspark.sql.readwriter import DataFrameWriter

    name, seen, write = "spark.sql.maxConcurrentOutputFileWriters", [], DataFrameWriter.parquet

    def noted(self, *args, **how):
        seen.append(spark.conf.get(name))
        return write(self, *args, **how)

    monkeypatch.setattr(DataFrameWriter, "parquet", noted)
    before = spark.conf.get(name)
    table = spark.range(4_000).selectExpr("id", f"id % {values} AS part", "IF(id % 7 = 0, NULL, id % 2) AS half")
    out = snapshots.export_snapshot(table, str(tmp_path / "out"), None, ["part", "half"])
    got = {(r.part, r.half): r.rows for r in out.collect()}
    assert got == {(r.part, r.half): r["count"] for r in table.groupBy("part", "half").count().collect()}
    assert seen == [str(snapshots.OPEN_FILES)] and spark.conf.get(name) == before
    assert sorted(r.id for r in snapshots.read_snapshot(spark, str(tmp_path / "out")).collect()) == list(range(4_000))
