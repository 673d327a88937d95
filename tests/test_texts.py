"""Masking, URIs, durations, small columns, log text."""

import pytest
from pyspark.sql import functions as F

from muster.functions import text as tx
from muster.functions.address import is_member_address
from muster.functions.durations import humanise_seconds
from muster.operators import report, texts
from muster.sources import logs


@pytest.mark.parametrize(
    ("seconds", "text"),
    [
        (0.0, "0 second(s)"), (59.9, "59 second(s)"), (60.0, "1 minute(s) 0 second(s)"),
        (3600.0, "1 hour(s) 0 minute(s) 0 second(s)"), (86400.0, "1 day(s) 0 hour(s) 0 minute(s) 0 second(s)"),
        (90061.0, "1 day(s) 1 hour(s) 1 minute(s) 1 second(s)"), (None, ""),
    ],
)
def test_durations(spark, seconds, text):
    df = spark.createDataFrame([(seconds,)], "s double")
    assert df.select(humanise_seconds(F.col("s"))).first()[0] == text


@pytest.mark.parametrize(
    ("address", "valid"),
    [("h:1", True), ("a:b:1", False), ("h", False), (":1", False), ("h:", False), ("h:x", False), (None, False)],
)
def test_member_address(spark, address, valid):
    assert spark.createDataFrame([(address,)], "a string").select(is_member_address(F.col("a"))).first()[0] is valid


URI = "mongodb://"


def test_uris(spark):
    rows = [
        (URI + "u:p%40w@h1,h2:5/db?x=1", "u", "p@w", ["h1:27017", "h2:5"], "db", True, URI + "*****:*****@h1:27017,h2:5/db", None),
        (URI + "h", None, None, ["h:27017"], "admin", False, URI + "h:27017", None),
        (URI + "h:7/", None, None, ["h:7"], "admin", False, URI + "h:7", None),
        (URI + ":7/db", None, None, [], "db", False, None, "missing host"),
        ("nonsense", None, None, [], None, None, None, "malformed"),
    ]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, uri string")
    parsed = texts.parse_uris(df, "uri").cache()
    nodes = {}
    for r in texts.uri_nodes(parsed, ["i"]).orderBy("i", "pos").collect():
        nodes.setdefault(r.i, []).append(r.host)
    for r in parsed.collect():
        want = rows[r.i]
        assert (r.username, r.password, nodes.get(r.i, []), r.database, r.error) == (*want[1:5], want[7])
        if want[7] is None:
            assert (r.is_cluster, r.masked) == want[5:7]
    got = [r[0] for r in df.orderBy("i").select(texts.looks_like_address(F.col("uri"))).collect()]
    assert got == [True, True, True, False, False]


def test_redaction_covers_the_whole_text(spark):
    text = ("x" * 200_000 + f" {URI}joe:secret@h/db run -u joe -p hunter2 --servicePassword k -p --quiet "
            + "y" * 200_000 + f" {URI}ann:other@h/db")
    out = texts.redact(spark.createDataFrame([(text,)], "t string"), "t").first()
    for secret in ("secret", "hunter2", "other", "joe", "ann"):
        assert secret not in out.redacted
    assert "-p --quiet" in out.redacted and out.redacted.endswith("*****:*****@h/db")
    assert (out.hits_uri, out.hits_login, out.hits_password_option) == (2, 2, 1)
    kept = texts.redact(spark.createDataFrame([(text,)], "t string"), "t", tx.MASKING_RULES_KEEP_USER).first()
    assert f"{URI}joe:****@h/db" in kept.redacted


def test_small_columns(spark):
    df = spark.createDataFrame(
        [("db version v3.2.1-rc0, x\n9.9.9", "123\n", "ab forked process: 77 c"), ("none", "12a", "x")], "v string, p string, f string")
    got = df.select(tx.version_in(F.col("v")), tx.pid_of(F.col("p")), tx.forked_pid(F.col("f")), tx.gib_to_bytes(F.lit(0.5)),
                    tx.ascii_only(F.lit("aéb"))).collect()
    assert [tuple(r) for r in got] == [("3.2.1-rc0", 123, 77, 2**29, "ab"), (None, None, None, 2**29, "ab")]


def test_server_templates(spark):
    df = spark.createDataFrame([("h:1", True, None), ("h:1", False, None), ("h:1", True, "d"), ("h:1", False, "d")],
                               "a string, auth boolean, db string")
    got = [r[0] for r in df.select(report.server_uri(F.col("a"), F.col("auth"), F.col("db"))).collect()]
    assert got == [URI + "[dbuser]:[dbpass]@h:1/[dbname]", URI + "h:1", URI + "[dbuser]:[dbpass]@h:1/d", URI + "h:1/d"]


LINES = ["lost line", "    INFO | 2024-01-02 03:04:05,678 | hello | world", "Traceback", "  more",
         "   ERROR | 2024-01-02 03:04:06,000 | ", "tail", " WARNING | 2024-13-99 03:04:06,000 | bad time"]


@pytest.mark.parametrize("hot_rows", [2, 1000])
def test_log_lines_attach_to_their_record(spark, hot_rows):
    df = spark.createDataFrame([("f", i, v) for i, v in enumerate(LINES)] + [("g", 0, "alone")], "file string, line bigint, value string")
    out = logs.parse_log(df, piece_lines=2, hot_rows=hot_rows).where("file = 'f'").orderBy("line").collect()
    assert [r.record for r in out] == [None, 1, 1, 1, 4, 4, 6]
    assert [r.level for r in out] == [None, "INFO", "INFO", "INFO", "ERROR", "ERROR", "WARNING"]
    assert out[1].message == "hello | world" and out[2].message == "Traceback" and out[6].ts is None
    assert str(out[3].ts) == "2024-01-02 03:04:05.678000"


def test_log_roundtrip(spark, tmp_path):
    records = spark.createDataFrame([("INFO", "2024-05-06 07:08:09.123", "a | b"), ("CRITICAL", "2024-05-06 07:08:09", "")], "l string, t string, m string")
    line = logs.format_line(F.col("l"), F.col("t").cast("timestamp"), F.col("m"))
    records.select(line.alias("value")).write.text(str(tmp_path / "log"))
    back = {(r.level, str(r.ts), r.message) for r in logs.read_log(spark, str(tmp_path / "log")).collect()}
    assert back == {("INFO", "2024-05-06 07:08:09.123000", "a | b"), ("CRITICAL", "2024-05-06 07:08:09", "")}


def test_tail(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("f"), F.col("id").alias("line"))
    assert {r.f: r["count"] for r in logs.tail(df, ["f"], ["line"]).groupBy("f").count().collect()} == {0: 15, 1: 15, 2: 15}
    plan = logs.tail(df, ["f"], ["line"])._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan
