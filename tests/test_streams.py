"""Growing files, event time behind a watermark, the levelled table: streams against the batch operators."""

import io
import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from muster.operators import activity as act
from muster.operators import health
from muster.sources import growing, logs
from muster.streaming import feeds
from muster.streaming.keyed import KeyedTable
from tests.test_activity import as_set, plain_intervals


# ---- files that grow

@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=60).map(lambda b: bytes(b"a\n\r"[x % 3] for x in b)), st.lists(st.integers(0, 60), max_size=5), st.integers(1, 9))
def test_every_finished_line_comes_once(data, cuts, chunk):
    """However the bytes are cut in ranges, the ranges give the lines that have ended, each with its place."""
    bounds = sorted({0, len(data), *(min(c, len(data)) for c in cuts)})
    before, growing.CHUNK_BYTES = growing.CHUNK_BYTES, chunk
    try:
        got = [x for a, b in zip(bounds, bounds[1:]) for found in growing.lines(io.BytesIO(data), a, b) for x in found]
    finally:
        growing.CHUNK_BYTES = before
    want, at = [], 0
    for line in data.split(b"\n")[:-1]:
        want.append((at, line.removesuffix(b"\r")))
        at += len(line) + 1
    assert got == want


def test_ranges_of_what_was_written():
    def cut(start, end):
        return [(r.file, r.start, r.stop) for r in growing.grown(start, end, 10)]

    assert cut({}, {"a": 25}) == [("a", 0, 10), ("a", 10, 20), ("a", 20, 25)]
    assert cut({"a": 25, "gone": 4}, {"a": 25, "b": 3}) == [("b", 0, 3)]
    assert cut({"a": 25}, {"a": 7}) == [("a", 0, 7)]  # replaced


def test_small_files_share_a_task(tmp_path):
    """A thousand short logs were a thousand tasks; now the tasks follow the bytes, and every range is read once, in order."""
    for i in range(1000):
        (tmp_path / f"{i:04}.log").write_text(f"a{i}\nb{i}\nunfinished")
    reader = growing.GrowingTextReader(str(tmp_path), "*.log", growing.SPLIT_BYTES)
    end = reader.latestOffset()
    tasks = reader.partitions({}, end)
    assert len(tasks) <= 2
    rows = [r for t in tasks for batch in reader.read(t) for r in batch.to_pylist()]
    assert [r["value"] for r in rows] == [f"{x}{i}" for i in range(1000) for x in "ab"]
    assert [r["at"] for r in rows[:4]] == [0, 3, 0, 3] and rows[0]["file"].endswith("0000.log")
    ranges = growing.grown({}, {"a": 25, "b": 5, "c": 4}, 10)
    assert [[(r.file, r.start, r.stop) for r in t.ranges] for t in growing.packed(ranges, 12, 1)] == [
        [("a", 0, 10)], [("a", 10, 20)], [("a", 20, 25), ("b", 0, 5)], [("c", 0, 4)]]


def test_the_offset_of_many_files_is_a_name(tmp_path):
    """Offsets and tasks held the paths of all files; with a folder for listings they name tables, and the rows are the same."""
    folder, kept = tmp_path / "in", tmp_path / "kept"
    (folder / "inner" / "deep").mkdir(parents=True)
    for i in range(500):
        (folder / f"{i:04}.log").write_text(f"a{i}\nb{i}\nunfinished")
    (folder / "inner" / "deep" / "é.log").write_text("one\n")
    (folder / "inner" / "_hidden.log").write_text("no\n")
    plain = growing.GrowingTextReader(str(folder), "*.log", 1 << 21)
    reader = growing.GrowingTextReader(f"file:{folder}", "*.log", 1 << 21, f"file:{kept}")

    def rows(reader, tasks):
        assert sum(len(cloudpickle.dumps(t)) for t in tasks) < 40_000 or reader is plain
        return [r for t in tasks for batch in reader.read(t) for r in batch.to_pylist()]

    first, whole = reader.latestOffset(), plain.latestOffset()
    assert len(json.dumps(first)) < 100 and reader.latestOffset() == first
    tasks = reader.partitions({}, first)
    assert 10 < len(tasks) < 20
    got = rows(reader, tasks)
    assert len(got) == 1001 and got == rows(plain, plain.partitions({}, whole)) == rows(reader, reader.partitions({}, first))
    with open(folder / "0003.log", "a") as file:
        file.write(" no more\n")
    (folder / "0005.log").write_text("new\n")
    (folder / "0007.log").unlink()
    second, later = reader.latestOffset(), plain.latestOffset()
    assert second != first
    got = rows(reader, reader.partitions(first, second))
    assert [(r["at"], r["value"]) for r in got] == [(6, "unfinished no more"), (0, "new")]
    assert got == rows(plain, plain.partitions(whole, later)) == rows(reader, reader.partitions(whole, second))
    assert rows(reader, reader.partitions(whole, later)) == got  # a batch that was planned before there were listings
    reader.commit(first)
    assert rows(reader, reader.partitions(first, second)) == got
    reader.commit(second)
    assert all("1" in f.name for f in kept.iterdir()) and reader.latestOffset() == second


def test_no_files_and_files_that_go(tmp_path):
    reader = growing.GrowingTextReader(str(tmp_path / "in"), "*", 10, str(tmp_path / "kept"))
    none = reader.latestOffset()
    assert reader.partitions({}, none) == []
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_text("x\n")
    one = reader.latestOffset()
    assert len(reader.partitions(none, one)) == 1
    (tmp_path / "in" / "a").unlink()
    assert reader.partitions(one, reader.latestOffset()) == []


def test_a_listing_of_many_batches(tmp_path, monkeypatch):
    monkeypatch.setattr(growing, "LISTED_ROWS", 7)
    for i in range(30):
        (tmp_path / f"{i * 7919 % 97:02}.log").write_text("x\n")
    reader = growing.GrowingTextReader(str(tmp_path), "*.log", growing.SPLIT_BYTES, str(tmp_path / "_kept"))
    first = reader.latestOffset()
    assert dict(reader.listed(first)) == growing.sizes(str(tmp_path), "*.log")
    assert [f for f, _ in reader.listed(first)] == sorted(growing.sizes(str(tmp_path), "*.log"))
    assert reader.latestOffset() == first
    (tmp_path / "99.log").write_text("y\n")
    assert reader.latestOffset() != first


HEAD = "    INFO | 2024-01-01 00:00:0{},000 | message {}"


def test_a_log_that_grows(spark, tmp_path):
    """Records and their tracebacks are torn between batches, the last line is often unfinished; nothing is lost or repeated."""
    rnd = random.Random(5)
    texts = {}
    for name in ("one.log", "two.log", "late.log"):
        lines = ["before any record"]
        for i in range(40):
            lines += [HEAD.format(i % 10, i), *["Traceback (most recent call last):", "  é", ""][: rnd.randrange(4)]]
        texts[name] = ("\n".join(lines) + "\n").encode()
    folder, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    folder.mkdir()
    (folder / "one.log.2023-12-31").write_text("rotated\n")
    written = dict.fromkeys(texts, 0)
    for batch in range(5):
        for name, text in texts.items():
            stop = len(text) if batch == 4 else min(len(text), written[name] + rnd.randrange(0, 500)) * (name != "late.log" or batch > 1)
            if stop > written[name]:
                with open(folder / name, "ab") as file:
                    file.write(text[written[name] : stop])
                written[name] = stop
        feeds.follow_log(spark, str(folder), out, checkpoint, pattern="*.log", split_bytes=90).awaitTermination()
    rows = feeds.read_records(spark, out)
    got = sorted((r.file.rsplit("/", 1)[1], r.line, r.record, r.level, r.message, r.continued) for r in rows.collect())
    whole = spark.createDataFrame(
        [(n, i, v) for n, t in texts.items() for i, v in enumerate(t.decode().split("\n")[:-1])], "file string, line bigint, value string")
    want = sorted((r.file, r.line, r.record, r.level, r.message, r.continued) for r in logs.parse_log(whole).collect())

    def key(r):
        return tuple(("", x) if x is not None else () for x in r)

    assert sorted(got, key=key) == sorted(want, key=key)
    assert rows.select("batch").distinct().count() > 2
    assert rows.where("record is not null and ts is null").isEmpty()


def test_the_checkpoint_of_a_followed_fleet_holds_no_files(spark, tmp_path):
    """Every offset held the size of every file, so the driver's memory grew with the fleet."""
    folder, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), tmp_path / "cp"
    folder.mkdir()
    for batch in range(2):
        for i in range(200):
            with open(folder / f"{i:03}.log", "a") as file:
                file.write(HEAD.format(batch, i) + "\n")
        feeds.follow_log(spark, str(folder), out, str(checkpoint), pattern="*.log").awaitTermination()
    assert feeds.read_records(spark, out).groupBy("file").agg(F.max("line").alias("n")).where("n = 1").count() == 200
    assert all(f.stat().st_size < 2000 for f in (checkpoint / "offsets").glob("[0-9]"))


# ---- the levelled table

SCHEMA = StructType().add("k", "string").add("v", "long").add("batch", "long").add("gone", "boolean")


def test_folders_follow_from_the_number(spark):
    table = KeyedTable(spark, "/nowhere", ["k"], ["batch"], SCHEMA, fan=3)
    assert table.parts(-1) == [] and table.parts(0) == [(0, 0)]
    assert table.parts(4) == [(1, 2), (0, 3), (0, 4)]
    assert table.parts(8) == [(2, 8)] and table.parts(13) == [(2, 8), (1, 11), (0, 12), (0, 13)]
    assert table.merged_by(8) == [(1, [(0, 6), (0, 7), (0, 8)]), (2, [(1, 2), (1, 5), (1, 8)])]
    assert table.merged_by(-1) == table.merged_by(0) == []


def test_newest_rows_in_levels(spark, tmp_path):
    """Rows change and go over 13 batches, one of which is run again; every state is what a dict would hold."""
    rnd = random.Random(6)
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], ["batch"], SCHEMA, gone="gone", fan=3, buckets=4)
    state = {}
    assert table.last_batch() == -1 and table.rows().count() == 0
    for batch in range(13):
        rows = [(f"k{rnd.randrange(20)}" if rnd.random() < 0.95 else None, rnd.randrange(100), batch, rnd.random() < 0.2)
                for _ in range(rnd.choice([0, 1, 6]))]
        rows = list({r[0]: r for r in rows}.values())
        df = spark.createDataFrame(rows, SCHEMA)
        for _ in range(2 if batch in (5, 8) else 1):
            table.write(batch, df)
        for k, v, _, gone in rows:
            state.pop(k, None)
            if not gone:
                state[k] = v
        assert table.last_batch() == batch
        if batch % 4 == 0 or batch == 8:
            assert {r.k: r.v for r in table.rows().collect()} == state
            wanted = spark.createDataFrame([("k1",), (None,), ("k5",), ("k5",), ("nope",)], "k string")
            assert {r.k: r.v for r in table.lookup(batch, wanted).collect()} == {k: state[k] for k in (None, "k1", "k5") if k in state}


def test_bytes_follow_the_keys_seen(spark, tmp_path):
    """A large table and then batches of one key each: what they write does not depend on the size of the table."""
    def size(folder):
        return sum(f.stat().st_size for f in folder.rglob("*.parquet"))

    schema = StructType.fromDDL("k bigint, v string, batch bigint")
    table = KeyedTable(spark, str(tmp_path), ["k"], ["batch"], schema, fan=2, buckets=2)
    table.write(0, spark.range(50_000).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"), F.lit(0).cast("bigint").alias("batch")))
    whole, later = size(tmp_path), []
    seen = {f for f in tmp_path.rglob("*.parquet")}
    for batch in range(1, 9):
        table.write(batch, spark.createDataFrame([(7, "x", batch)], schema))
        fresh = [f for f in tmp_path.rglob("*.parquet") if f not in seen]
        seen |= set(fresh)
        later.append(sum(f.stat().st_size for f in fresh))
    rewrites = [n for n in later if n > whole / 2]
    assert len(rewrites) == 3  # batches 1, 3 and 7: each level takes the table up once
    assert sum(later) - sum(rewrites) < whole / 50
    assert table.rows().count() == 50_000 and table.rows().where("k = 7").first().v == "x"


# ---- event time

@pytest.fixture(scope="module")
def records():
    rnd, rows = random.Random(3), []
    for i in range(300):
        rows.append(("hot" if i % 3 == 0 else f"s{rnd.randrange(12)}", rnd.randrange(200) * 1_000_000, i, rnd.choice(["start", "stop", "view"])))
    return sorted(rows, key=lambda r: (r[1], r[2]))


@pytest.fixture(scope="module")
def table(spark, records):
    return spark.createDataFrame(records, "server string, us bigint, seq bigint, op string").withColumn("ts", F.timestamp_micros("us")).cache()


def arrive(spark, table, folder, pieces, follow):
    """The pieces of a table as batches of their own, in the order given."""
    for piece in pieces:
        piece.coalesce(1).write.mode("append").parquet(folder)
        follow(spark.readStream.schema(table.schema).parquet(folder)).awaitTermination()


def shuffled(table, late):
    """Five pieces in which a record comes up to ``late`` seconds after its time."""
    arrival = F.floor(F.col("us") / 1_000_000) + F.pmod(F.xxhash64("seq"), F.lit(late))
    return [table.where(F.floor(arrival / ((200 + late) / 5)) == i) for i in range(5)]


def files(path):
    return sum(1 for _ in path.rglob("*.parquet"))


def test_intervals_of_unordered_batches(spark, table, records, tmp_path):
    """Stops come before their starts, across batches; with a delay as long as the disorder the result is that of the batch form."""
    out = str(tmp_path / "out")
    arrive(spark, table, str(tmp_path / "in"), shuffled(table, 60), lambda s: feeds.follow_intervals(
        s, "server", "ts", "seq", "op", out, str(tmp_path / "cp"), delay_seconds=60, piece_seconds=7))
    assert as_set(feeds.read_intervals(spark, out)) == plain_intervals(records)
    assert spark.read.parquet(f"{out}/late").count() == 0
    assert spark.read.parquet(f"{out}/settled").select("batch").distinct().count() > 2
    # state: the records within the delay, and one start a server
    us = F.unix_micros("ts")
    waiting = spark.read.parquet(f"{out}/waiting/batch=4")
    last = table.agg(F.max("us")).first()[0]
    assert waiting.where(us < last - 60_000_000).count() == 0 < waiting.count()
    assert not (tmp_path / "out/waiting/batch=2").exists()
    pending = feeds._pending_table(spark, out, waiting.schema).rows(4)
    assert pending.count() == pending.select("server").distinct().count() <= 13


def test_late_records_pair_with_nothing(spark, table, records, tmp_path):
    """A shorter delay than the disorder: what the watermark has passed is set aside, the rest is as if it had never been."""
    out = str(tmp_path / "out")
    arrive(spark, table, str(tmp_path / "in"), shuffled(table, 60), lambda s: feeds.follow_intervals(
        s, "server", "ts", "seq", "op", out, str(tmp_path / "cp"), delay_seconds=5))
    late = {r.seq for r in spark.read.parquet(f"{out}/late").collect()}
    assert late
    assert as_set(feeds.read_intervals(spark, out)) == plain_intervals([r for r in records if r[2] not in late])


def outcomes(df):
    return sorted((r.seq, r.c or 0, r.met) for r in df.select("seq", F.unix_micros("confirmed").alias("c"), "met").collect())


def follow(out, checkpoint, **more):
    return lambda s: feeds.follow_outcomes(
        s, ["server"], "ts", F.col("op") == "start", F.col("op") == "stop", 5, out, checkpoint, keep=["seq"], **more)


def test_outcomes_of_unordered_batches(spark, table, tmp_path):
    out = str(tmp_path / "out")
    arrive(spark, table, str(tmp_path / "in"), shuffled(table, 60), follow(out, str(tmp_path / "cp"), delay_seconds=60))
    batch = act.await_outcome(table.where("op = 'start'"), table.where("op = 'stop'"), ["server"], "ts", "ts", 5, ["seq"])
    got = feeds.read_outcomes(spark, out, ["server"], 5, ["seq"])
    assert outcomes(got) == outcomes(batch)
    assert got.where("late").isEmpty()
    assert spark.read.parquet(f"{out}/settled").select("batch").distinct().count() > 2


def at(spark, rows):
    df = spark.createDataFrame(rows, "server string, us bigint, seq bigint, op string")
    return df.withColumn("ts", F.timestamp_micros(F.col("us") * 1_000_000))


def test_a_confirmation_later_than_the_watermark_is_none(spark, tmp_path):
    pieces = [
        at(spark, [("a", 10, 1, "start"), ("b", 10, 2, "start"), ("x", 30, 3, "view"), ("c", 29, 7, "start")]),
        at(spark, [("x", 40, 4, "start")]),  # the watermark passes 10 + 5
        at(spark, [("a", 12, 5, "stop"), ("c", 33, 8, "stop"), ("d", 11, 6, "start"), ("x", 50, 9, "start")]),
    ]
    out = str(tmp_path / "out")
    arrive(spark, pieces[0], str(tmp_path / "in"), pieces, follow(out, str(tmp_path / "cp"), delay_seconds=10))
    rows = {r.seq: (r.met, r.late) for r in feeds.read_outcomes(spark, out, ["server"], 5, ["seq"]).collect()}
    assert rows == {1: (False, False), 2: (False, False), 7: (True, False), 4: (False, False), 6: (False, True), 9: (False, False)}
    assert sorted(r.seq for r in spark.read.parquet(f"{out}/late").collect()) == [5, 6]


def test_a_record_from_the_future_closes_nothing(spark, tmp_path):
    far = 4_000_000_000  # seconds: the year 2096
    pieces = [at(spark, [("a", 10, 1, "start"), ("z", far, 2, "start")]), at(spark, [("a", 12, 3, "stop"), ("x", 30, 4, "start")])]
    for ahead, met in ((3600, True), (None, False)):
        out = str(tmp_path / f"out{ahead}")
        arrive(spark, pieces[0], str(tmp_path / f"in{ahead}"), pieces, follow(out, str(tmp_path / f"cp{ahead}"), delay_seconds=5, ahead_seconds=ahead))
        rows = {r.seq: r.met for r in feeds.read_outcomes(spark, out, ["server"], 5, ["seq"]).collect()}
        assert rows == {1: met, 2: False, 4: False}


def test_a_batch_that_runs_again(spark, table, tmp_path):
    """The work of a batch done twice, as after a failure between its writes and its commit, leaves the same rows."""
    out = str(tmp_path / "out")
    steps = []

    class Stream:
        def __getattr__(self, name):
            def keep(*args, **kwargs):
                steps.extend(args if name == "foreachBatch" else [])
                return self
            return keep

        writeStream = property(lambda self: self)

    feeds.follow_intervals(Stream(), "server", "ts", "seq", "op", out, "none", delay_seconds=60)
    for number, piece in enumerate(shuffled(table, 60)):
        for _ in range(2):
            steps[0](piece, number)
    got = feeds.read_intervals(spark, out)
    assert got.count() == table.where("op = 'start'").count()
    assert as_set(got) == as_set(act.lifecycle_intervals(table, "server", "ts", "seq", "op"))


@pytest.mark.parametrize("fan", [2, 8])
def test_status_feed(spark, table, tmp_path, fan):
    out = str(tmp_path / "out")
    arrive(spark, table, str(tmp_path / "in"), shuffled(table, 60), lambda s: feeds.status_feed(
        s, ["server"], ["ts", "seq"], out, str(tmp_path / "cp"), fan=fan))
    got = {r.server: r.seq for r in feeds.read_latest(spark, out, ["server"], ["ts", "seq"], table.schema, fan=fan).collect()}
    want = {r.server: r.seq for r in health.latest_snapshot(table, ["server"], ["ts", "seq"]).collect()}
    assert got == want
