"""Conflicts, drift, ids and plans, against a plain restatement on small random clusters."""

import random

import pytest
from pyspark.sql import functions as F

from muster.operators import addresses, ordered, reconcile

IPS = {"a": ["1"], "b": ["1", "2"], "c": ["2"], "d": [], "1": []}


@pytest.fixture(scope="module")
def hosts(spark):
    table = spark.createDataFrame([(h, ips) for h, ips in IPS.items()], "host string, ips array<string>")
    return addresses.host_ips(table).cache()


def same(x, y):
    """Equal ports, and equal hosts or a shared IP."""
    (h1, p1), (h2, p2) = x.split(":"), y.split(":")
    return p1 == p2 and (h1 == h2 or bool(set(IPS.get(h1, [])) & set(IPS.get(h2, []))))


def random_members(seed, n=120):
    rnd, rows, size = random.Random(seed), [], {}
    for _ in range(n):
        c = f"c{rnd.randrange(25)}"
        pos = size[c] = size.get(c, -1) + 1
        rows.append((c, pos, rnd.choice([None, 0, 0, 1, 2, 3, 7]), rnd.choice([None, "s1", "s2", "s3", "s4"]),
                     f"{rnd.choice(list(IPS))}:{rnd.randrange(2)}"))
    return rows


SCHEMA = "cluster string, pos bigint, id bigint, server string, address string"


def by_cluster(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("strict", [False, True])
def test_conflicts(spark, hosts, strict):
    rows = random_members(1)
    df = spark.createDataFrame(rows, SCHEMA)
    found = reconcile.find_conflicts(
        df, "cluster", "pos", F.col("id"), F.col("server"), F.col("address"), hosts, strict).cache()
    got = {(r.cluster, r.pos, r.kind): r.first_pos for r in found.collect()}
    firsts = {r.cluster: (r.first_pos, r.pos, r.kind) for r in reconcile.first_conflict(found, "cluster", "pos").collect()}
    want, stops = {}, {}
    for c, members in by_cluster(rows).items():
        for i, m in enumerate(members):
            for j in range(i + 1, len(members)):
                o = members[j]
                kinds = []
                if m[2] == o[2] and (m[2] is not None if strict else m[2]):
                    kinds.append("id")
                if m[3] and m[3] == o[3]:
                    kinds.append("server")
                if same(m[4], o[4]):
                    kinds.append("address")
                for kind in kinds:
                    key = (c, j, kind)
                    want[key] = min(want.get(key, i), i)
                if kinds and c not in stops:
                    stops[c] = (i, j, kinds[0])
    assert got == want
    assert firsts == stops


def current_rows(seed):
    rnd, rows = random.Random(seed), []
    for c in range(25):
        if rnd.random() < 0.8:
            ids = rnd.sample(range(8), rnd.randrange(0, 6))
            rows += [(f"c{c}", i, at, f"{rnd.choice(list(IPS))}:{rnd.randrange(2)}") for at, i in enumerate(ids)]
    return rows


@pytest.mark.parametrize("strict", [False, True])
def test_drift_keeps_the_last_error(spark, hosts, strict):
    rows, current = random_members(2), current_rows(3)
    df = spark.createDataFrame(rows, SCHEMA)
    cur = spark.createDataFrame(current, "cluster string, id bigint, at bigint, host string")
    out = reconcile.find_drift(df, cur, "cluster", "pos", "id", F.col("address"), F.col("host"), hosts, strict)
    got = {(r.cluster, r.pos): (r.kind, r.current_id) for r in out.collect()}
    want, now = {}, by_cluster(current)
    for c, pos, mid, _, address in rows:
        for _, cid, _, host in now.get(c, []):
            if not (mid is not None if strict else mid):
                continue
            if mid == cid and not same(address, host):
                want[c, pos] = ("id_moved", cid)
            elif mid != cid and same(address, host):
                want[c, pos] = ("address_renamed", cid)
    assert got == want


@pytest.mark.parametrize("hot_rows", [3, 10_000])
def test_ids(spark, hosts, hot_rows):
    rows, current = random_members(4), current_rows(5)
    df = spark.createDataFrame(rows, SCHEMA)
    cur = spark.createDataFrame(current, "cluster string, id bigint, at bigint, host string")
    configured = [f"c{i}" for i in range(12)] + [r[0] for r in current]
    known = spark.createDataFrame([(c,) for c in set(configured)], "cluster string")
    out = reconcile.assign_ids(
        df, cur, "cluster", "pos", "id", F.col("address"), F.col("host"), [ordered.count_pieces(F.col("pos"), 2)],
        hosts, configured=known, hot_rows=hot_rows)
    got = {(r.cluster, r.pos): r.member_id for r in out.collect()}
    want, now = {}, by_cluster(current)
    for c, members in by_cluster(rows).items():
        fresh = max([0] + [r[1] for r in now.get(c, [])]) + 1 if c in configured else 0
        for _, pos, mid, _, address in members:
            if mid is None:
                mid = next((cid for _, cid, _, host in now.get(c, []) if same(address, host)), None)
                if mid is None:
                    mid, fresh = fresh, fresh + 1
            want[c, pos] = mid
    assert got == want


def test_ids_without_any_configuration(spark):
    df = spark.createDataFrame([("c", 0, None, None, "a:1"), ("c", 1, 0, None, "b:1"), ("c", 2, None, None, "c:1")], SCHEMA)
    out = reconcile.assign_ids(df, None, "cluster", "pos", "id", F.col("address"), None, [ordered.count_pieces(F.col("pos"))])
    assert [r.member_id for r in out.orderBy("pos").collect()] == [0, 0, 1]  # given ids are not reserved


def test_one_shared_address_stays_linear(spark):
    """Every row has the same address: the result has one row per left row."""
    left = spark.range(3000).withColumn("address", F.lit("h:1"))
    right = spark.range(3000).select((F.col("id") + 10).alias("id"), F.lit("h:1").alias("address"))
    out = addresses.match_addresses(left, ["id"], F.col("address"), right, ["id"], ["id"], F.col("address"))
    assert out.count() == 3000
    assert out.select("match.id").distinct().collect()[0].id == 10


def test_member_validation(spark):
    rows = [(None, None, None, None, None), (None, "a:b:1", None, None, None), (None, "h", None, None, None),
            (None, ":1", None, None, None), ("gone", None, None, None, None), ("s", None, "s", None, None),
            ("s", None, "s", "h:1", "x.y"), ("s", "h:1", "s", "h:1", "2.0")]
    df = spark.createDataFrame(rows, "ref string, host string, resolved string, address string, version string")
    c = F.col
    out = reconcile.validate_members(df, c("ref"), c("host"), c("resolved"), c("address"), c("version"))
    assert [r.errors for r in out.collect()] == [
        ["no_server_or_host"], ["bad_host"], ["bad_host"], ["bad_host"], ["unresolved_server"], ["no_address"],
        ["invalid_version"], []]


def test_server_validation(spark):
    df = spark.createDataFrame(
        [("1.6.0", {}), ("zzz", {"PATH": "x"}), (None, {"TCMALLOC_AGGRESSIVE_DECOMMIT": "y"})],
        "mongoVersion string, env map<string,string>")
    assert [r.errors for r in reconcile.validate_servers(df, environment="env").collect()] == [
        ["unsupported_version"], ["invalid_version", "unknown_environment_variable"], []]


def test_settings_of_a_new_configuration(spark):
    clusters = spark.createDataFrame([("a", {"x": "1"}), ("b", None), ("n", {"y": None})], "cluster string, declared map<string,string>")
    current = spark.createDataFrame([("a", 4, {"x": "0", "z": "2"}), ("b", 1, {"x": "0"}), ("n", 2, {"y": "3"})],
                                    "cluster string, version int, settings map<string,string>")
    out = reconcile.desired_header(clusters, current, "cluster", F.col("declared"), F.lit(False))
    got = {r.cluster: (r.version, r.settings, r.configsvr) for r in out.collect()}
    assert got == {"a": (5, {"x": "1", "z": "2"}, None), "b": (2, None, None), "n": (3, {"y": None}, None)}


def test_desired_modes_and_tags(spark):
    df = spark.createDataFrame([("c", 0, "h0", False, "alt0"), ("c", 1, "h1", True, "alt1"), ("c", 2, "h2", False, "h2")],
                               "cluster string, pos bigint, host string, arbiter boolean, alt string")
    cur = spark.createDataFrame([("c", 0, "old", 7)], "cluster string, pos bigint, host string, id bigint")
    tags = reconcile.alternate_tags(F.lit(None).cast("map<string,string>"), F.col("host"), F.col("arbiter"), {"t": F.col("alt")})

    def hosts_of(**mode):
        out = reconcile.build_desired(df, cur, "cluster", "pos", F.col("host"), tags=tags, **mode)
        return [(r.host, r.tags) for r in out.orderBy("turn", "pos").collect()]

    assert hosts_of() == [("h0", {"t": "alt0"}), ("h1", None), ("h2", None)]
    assert hosts_of(only=F.col("pos") == 2) == [("h2", None)]
    assert hosts_of(add=F.col("pos") == 2) == [("old", None), ("h2", None)]


def test_applied(spark):
    expected = spark.createDataFrame([("a", 3), ("b", 3), ("c", 3), ("d", 0)], "c string, want int")
    seen = spark.createDataFrame([("a", 3), ("b", 9)], "c string, got int")
    for force, want in ((False, [True, False, False, True]), (True, [True, True, False, True])):
        out = reconcile.verify_applied(expected, seen, ["c"], "want", "got", force).orderBy("c")
        assert [r.applied for r in out.collect()] == want


def test_relocation_needs_a_known_shard(spark):
    holdings = spark.createDataFrame([("db1", "a"), ("db2", "a"), ("db3", "b"), ("db4", "c")], "db string, shard string")
    moves = spark.createDataFrame([("a", "b"), ("b", "zzz")], "shard string, destination string")
    shards = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    got = {(r.db, r.destination, r.error) for r in reconcile.plan_relocation(holdings, moves, shards, "shard", "id").collect()}
    assert got == {("db1", "b", None), ("db2", "b", None), ("db3", "zzz", "unknown destination")}


def test_a_repeated_current_id_is_named(spark):
    members = spark.createDataFrame([("c", 0, 1, "h:1"), ("d", 0, 2, "h:1")], "cluster string, pos int, id int, address string")
    current = spark.createDataFrame(
        [("c", 1, 0, "x:1"), ("d", 2, 0, "h:1"), ("d", 7, 1, "y:1"), ("d", 7, 2, "z:1")], "cluster string, id int, at int, host string")

    def drift(rows):
        return reconcile.find_drift(members, rows, "cluster", "pos", "id", F.col("address"), F.col("host")).collect()

    assert [(r.cluster, r.kind) for r in drift(current)] == [("c", "id_moved")]  # no member asks for id 7
    again = current.unionByName(spark.createDataFrame([("c", 1, 1, "y:1")], current.schema))
    with pytest.raises(Exception, match="id 1 repeats in the current configuration of c"):
        drift(again)


def test_conflicts_of_large_clusters(spark, hosts):
    """Clusters above and below the limit, and members without a cluster, which clash with nothing."""
    rows = [r for i in range(4) for r in random_members(i, 60)] + [(None, 0, 1, "s1", "a:1"), (None, 1, 1, "s1", "a:1")]
    rows = [(c, at, i, s, a) for at, (c, _, i, s, a) in enumerate(rows)]
    df = spark.createDataFrame(rows, SCHEMA)

    def found(**how):
        out = reconcile.find_conflicts(df, "cluster", "pos", F.col("id"), F.col("server"), F.col("address"), hosts, **how)
        return sorted((r.cluster, r.pos, r.kind, r.first_pos) for r in out.collect())

    want = {}
    for c, pos, i, s, a in rows:
        for before in rows[:pos]:
            if c is not None and c == before[0]:
                for kind, clash in (("id", i and i == before[2]), ("server", s and s == before[3]), ("address", same(a, before[4]))):
                    if clash:
                        want.setdefault((c, pos, kind), before[1])
    want = sorted((*k, v) for k, v in want.items())
    assert found() == found(hot_rows=9) == found(hot_rows=2) == want


def test_members_dealt_by_cluster_are_not_shuffled_again(spark):
    """Conflicts took two more shuffles of three rows a member, and a map of all keys in each task."""
    df = spark.createDataFrame(random_members(1), SCHEMA).repartition(5, "cluster")
    found = reconcile.find_conflicts(df, "cluster", "pos", F.col("id"), F.col("server"), F.col("address"))
    firsts = reconcile.first_conflict(found, "cluster", "pos")
    for plan in (found, firsts):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert text.count("Exchange") == 1 and "Join" not in text


def test_members_meet_the_current_ones_in_one_join(spark, tmp_path):
    """Without a host table the members are read and shuffled once for their matches, not cut in two and joined back."""
    spark.createDataFrame([*random_members(4), ("c1", 90, None, "s1", "a"), ("c1", 91, None, "s1", None)], SCHEMA).write.parquet(
        str(tmp_path / "declared"))
    df = spark.read.schema(SCHEMA).parquet(str(tmp_path / "declared"))
    cur = spark.createDataFrame([*current_rows(5), ("c1", 70, 90, "a"), ("c1", 71, 91, None)], "cluster string, id bigint, at bigint, host string")
    no_ips = spark.createDataFrame([], "host string, ip string")

    def ids(hosts):
        return reconcile.assign_ids(
            df, cur, "cluster", "pos", "id", F.col("address"), F.col("host"), [ordered.count_pieces(F.col("pos"), 2)], hosts)

    one = ids(None)
    assert one.columns == ids(no_ips).columns
    assert sorted(map(str, one.collect())) == sorted(map(str, ids(no_ips).collect()))
    assert one._jdf.queryExecution().sparkPlan().toString().count("FileScan") == 1
