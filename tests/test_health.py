"""Lag, ranking, status, retention, outcomes."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from muster.operators import health, lookup
from muster.plans.export_source import export_sources

T0 = dt.datetime(2024, 1, 1)
MEMBERS = "c string, pos bigint, server string, state string, passive boolean, optime timestamp"


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def best(spark, rows, **kwargs):
    df = spark.createDataFrame(rows, MEMBERS)
    out = export_sources(df, ["c"], ["pos"], "server", "optime", F.col("state") == "P", F.col("state") == "S", "passive", **kwargs)
    return [(r.c, r.server, r.lag) for r in out.orderBy("c", "lag").collect()]


def test_ranking(spark):
    rows = [
        ("passive", 0, "p", "P", None, at(100)), ("passive", 1, "x", "S", False, at(99)), ("passive", 2, "y", "S", True, at(10)),
        ("tie", 0, "a", "S", None, at(95)), ("tie", 1, "p", "P", None, at(100)), ("tie", 2, "b", "S", None, at(105)),
        ("ahead", 0, "p", "P", None, at(100)), ("ahead", 1, "a", "S", None, at(103)), ("ahead", 2, "b", "S", None, at(98)),
        ("alone", 0, "p", "P", None, at(1)), ("headless", 0, "a", "S", None, at(1)),
    ]
    # a cluster without a leader is not ranked but named
    assert best(spark, rows) == [("ahead", "b", 2.0), ("headless", None, None), ("passive", "y", 90.0), ("tie", "a", 5.0)]
    # a lag equal to the limit stays, 0 means no limit
    assert best(spark, rows, max_lag=5.0) == [("ahead", "b", 2.0), ("headless", None, None), ("passive", "x", 1.0), ("tie", "a", 5.0)]
    assert best(spark, rows, max_lag=0) == best(spark, rows)
    assert len(best(spark, rows, k=2)) == 7


def test_hot_cluster_is_reduced_before_the_shuffle(spark):
    df = spark.range(50_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("c"), F.col("id").alias("pos"),
        F.concat(F.lit("s"), "id").alias("server"), F.when(F.col("id") % 2 == 0, "P").otherwise("S").alias("state"),
        F.lit(False).alias("passive"), F.timestamp_seconds("id").alias("optime"))
    out = export_sources(df, ["c"], ["pos"], "server", "optime", F.col("state") == "P", F.col("state") == "S", "passive")
    led = out.where("not missing_leader")
    assert [(r.c, r.leader, r.server, r.lag) for r in led.collect()] == [("hot", "s0", "s3", 3.0)]
    assert out.where("missing_leader and server is null").count() == 16_667  # odd and not divisible by 3
    plan = out._jdf.queryExecution().toString()
    assert "partial_min_by" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_report(spark):
    status = spark.createDataFrame(
        [("c", "a:1", "PRIMARY", True, at(100), None), ("c", "b:1", "SECONDARY", None, at(40), ""),
         ("c", "d:1", "ARBITER", False, None, None), ("c", "e:1", "RECOVERING", False, at(90061 + 100), "slow")],
        "cluster_id string, name string, stateStr string, is_self boolean, optimeDate timestamp, errmsg string")
    config = spark.createDataFrame(
        [("c", "b:1", 0, 1, False, 5, {"dc": "x"}), ("c", "e:1", 1, 0, True, None, {})],
        "cluster_id string, host string, priority int, votes int, hidden boolean, slaveDelay bigint, tags map<string,string>")
    got = {r.address: r.asDict() for r in health.member_report(status, config).collect()}
    assert set(got) == {"b:1", "d:1", "e:1"}
    b, d, e = got["b:1"], got["d:1"], got["e:1"]
    assert (b["lag"], b["lag_text"], b["errmsg"], b["priority"], b["votes"], b["hidden"], b["slaveDelay"], b["tags"]) == (
        60.0, "1 minute(s) 0 second(s)", None, 0, None, None, 5, {"dc": "x"})
    assert d["lag"] is None
    assert (e["lag_text"], e["priority"], e["votes"], e["hidden"], e["tags"]) == (
        "1 day(s) 1 hour(s) 1 minute(s) 1 second(s)", None, 0, True, None)


def test_retention(spark):
    log = spark.createDataFrame([("a", 10), ("a", 3609), ("a", 3610), ("one", 5), ("short", 0), ("short", 3599)], "k string, s bigint")
    keys = spark.createDataFrame([("a",), ("one",), ("short",), ("none",)], "k string")
    got = {r.k: r.span for r in health.retention_span(log, ["k"], F.col("s"), keys).collect()}
    assert got == {"a": "3600 secs (1 hours)", "one": "0 secs (0 hours)", "short": "3599 secs (0 hours)", "none": ""}


def test_config_is_read_from_the_primary_first(spark):
    rows = [("p", 0, "x", False, False), ("p", 1, None, True, False), ("q", 0, "arb", False, True), ("q", 1, None, False, False),
            ("q", 2, "m", False, False), ("r", 0, "arb", False, True), ("none", 0, None, False, False)]
    df = spark.createDataFrame(rows, "c string, pos int, conf string, is_primary boolean, arb boolean")
    out = lookup.first_config(df, ["c"], ["pos"], "conf", F.col("is_primary"), F.col("arb"))
    assert {r.c: r.conf for r in out.collect()} == {"p": None, "q": "m", "r": "arb"}


@pytest.mark.parametrize(
    ("error", "start", "stop", "online"),
    [
        ("Timed Out; SSL handshake failed", "timed_out", "timed_out", "online"),
        ("connection closed, SSL handshake failed", "port_in_use", "ssl_mismatch", "online"),
        ("connection closed", "port_in_use", "too_many_connections", "online"),
        ("ssl handshake failed", "other", "other", "online"),
        ("connection refused", "other", "other", "offline"),
        (None, None, None, None),
    ],
)
def test_outcomes(spark, error, start, stop, online):
    df = spark.createDataFrame([(error,)], "e string")
    df = health.classify_outcome(df, "e", health.START_RULES, name="a")
    df = health.classify_outcome(df, "e", health.STOP_RULES, name="b")
    row = health.classify_outcome(df, "e", health.ONLINE_RULES, "online", "c").first()
    assert (row.a, row.b, row.c) == (start, stop, online)


def test_first_source(spark):
    holdings = spark.createDataFrame([("x", "mirror", 2), ("x", "main", 1), ("y", "mirror", 2)], "v string, source string, turn int")
    asked = spark.createDataFrame([("x",), ("y",), ("z",)], "v string")
    got = {r.v: (r.source, r.missing) for r in lookup.first_source(asked, holdings, ["v"], "source", "turn").collect()}
    assert got == {"x": ("main", False), "y": ("mirror", False), "z": (None, True)}
