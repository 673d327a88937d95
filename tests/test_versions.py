"""Version grammar, order and matching."""

import pytest
from pyspark.sql import functions as F

from muster.functions import versions as vs
from muster.operators import options as op
from muster.operators import versions as ver
from muster.operators.layers import settings_text

LESS = [
    ("1.2.0", "1.2.1", True), ("1.2.0", "1.2.0", False), ("1.2.0", "1.2.0C", False), ("1.2.0-rc1", "1.2.0-rc0", False),
    ("1.2.0-rc0", "1.2.0-rc1", True), ("1.2.0-rc0", "1.2.0", True), ("1.2.0-rc0", "1.2.1", True),
    ("2.9", "2.10", True), ("3.0.0-pre-", "3.0.0", True), ("1.2", "1.2.0", False), ("1.2.0", "1.2", False),
]
VALID = {"1.0.1": True, "0.1": True, "0.1a": True, "0.1c": True, "1.8.9-rc0": True, "1": False, "a.1.2.3.4": False,
         " 2.0 ": True, "": False, "x.y": False}


def test_order(spark):
    rows = spark.createDataFrame(LESS, "a string, b string, want boolean")
    got = rows.select("a", "b", "want", (vs.version_key(F.col("a")) < vs.version_key(F.col("b"))).alias("less")).collect()
    assert [r for r in got if r.want != r.less] == []


def test_validity(spark):
    rows = spark.createDataFrame(list(VALID.items()), "v string, want boolean")
    got = rows.select("v", "want", vs.is_valid(F.col("v")).alias("valid")).collect()
    assert [r for r in got if r.want != r.valid] == []


def test_literal_bounds_equal_parsed_ones(spark):
    one = spark.range(1)
    for text in ("1.8", "2.6.1", "3.0.0"):
        assert one.select(vs.version_key(F.lit(text)) == vs.bound_key(text)).first()[0]


INSTALLS = [
    ("/a", "2.4.1", "community"), ("/b", "2.6.9", None), ("/c", "2.6.9", "community"), ("/d", "2.7.3", "community"),
    ("/e", "3.1.0", "enterprise"), ("/f", "2.6.2", "enterprise"), ("/g", "rubbish", "community"),
]


@pytest.mark.parametrize(
    ("preference", "version", "edition", "path"),
    [
        (ver.EXACT, "2.4.1", "community", "/a"),
        (ver.EXACT, "2.4.1", "enterprise", None),  # the edition counts
        (ver.EXACT, "2.6.9", None, "/b"),  # first path among equals
        (ver.LATEST_MINOR, "2.6.0", "enterprise", "/f"),
        (ver.EXACT_OR_MINOR, "2.6.1", "community", "/b"),
        (ver.EXACT_OR_MINOR, "2.4.1", "community", "/a"),
        (ver.MAJOR_GE, "2.0.0", "community", "/d"),  # the highest, although the closest might be expected
        (ver.MAJOR_GE, "3.0.0", "community", None),
        (ver.LATEST_STABLE, "9.9.9", "enterprise", "/b"),
        (ver.EXACT, None, "enterprise", "/b"),  # no version asked: latest stable of any edition
    ],
)
def test_matching(spark, preference, version, edition, path):
    installs = spark.createDataFrame(INSTALLS, "path string, version string, edition string")
    asked = spark.createDataFrame([(version, edition)], "version string, edition string")
    assert ver.match_versions(asked, installs, preference).first().match_path == path


def test_default_without_stable(spark):
    installs = spark.createDataFrame([("/x", "2.5.0", None), ("/y", "2.7.0", None)], "path string, version string, edition string")
    asked = spark.createDataFrame([("1.0.0", None)], "version string, edition string")
    assert ver.match_versions(asked, installs, ver.DEFAULT).first().match_path == "/y"


def test_restore_avoids_one_version(spark):
    rows = spark.createDataFrame([("3.0.7",), ("3.0.8",), (None,)], "v string")
    version, preference = ver.restore_request(F.col("v"))
    got = [(r[0], r[1]) for r in rows.select(version, preference).collect()]
    assert got == [("3.0.6", ver.EXACT), ("3.0.8", ver.EXACT_OR_MINOR), (None, ver.EXACT_OR_MINOR)]


def test_gates(spark):
    rows = spark.createDataFrame(
        [("2.2", {"authenticationDatabase": "a"}), ("2.5", {"authenticationDatabase": "a", "restoreDbUsersAndRoles": "true"}),
         ("3.0.0", {"writeConcern": "x"}), ("3.4", {"continueOnError": "true"}), (None, {"authenticationDatabase": "a"}), ("3.0.0-rc1", {})],
        "version string, options map<string,string>")
    got = op.gate_options(rows, "options", "version", op.IMPORT_GATES).select(settings_text(F.col("options"))).collect()
    assert [r[0] for r in got] == [
        "", "authenticationDatabase=a", "stopOnError=true,writeConcern=x", "continueOnError=true,writeConcern={w:1}",
        "authenticationDatabase=a", ""]


def test_arguments_drop_what_is_false(spark):
    options = {"b": "true", "a": "x", "zero": "0", "no": "false", "empty": "", "none": "[]", "list": '["p","q"]'}
    df = spark.createDataFrame([(options,)], "o map<string,string>")
    assert df.select(op.option_arguments(F.col("o"))).first()[0] == ["--a", "x", "--b", "--list", "p", "--list", "q"]
    assert df.select(op.option_arguments(F.col("o"), ["a"])).first()[0] == ["--a", "x"]


def test_roles(spark):
    df = spark.createDataFrame([({"keyFile": "k", "wiredTigerCacheSizeGB": "1.5"}, True), ({"wiredTigerCacheSizeGB": "2"}, False)],
                               "o map<string,string>, alone boolean")
    out = op.role_options(df, "o", F.lit("rs"), F.col("alone"), ~F.col("alone"), F.lit(None).cast("boolean"))
    assert [r.o for r in out.collect()] == [{}, {"wiredTigerCacheSizeGB": "2", "replSet": "rs", "configsvr": "true"}]


def test_artifacts(spark):
    wanted = spark.createDataFrame([("2.6.0",), ("3.2.9",)], "version string")
    rows = ver.artifact_catalog(wanted, [("linux", "64", "debian", "7.1")]).collect()
    got = {(r.version, r.edition): r.url for r in rows}
    assert ("2.6.0", "community_ssl") not in got
    assert got["2.6.0", "enterprise"].endswith("/linux/mongodb-linux-x86_64-subscription-debian71-2.6.0.tgz")
    assert got["3.2.9", "community_ssl"].endswith("/linux/mongodb-linux-x86_64-debian71-3.2.9.tgz")


def test_typed_options_keep_texts(spark):
    """The number 0 goes, the text "0" stays; lists, numbers and flags are rendered by their types."""
    rows = [
        ('{"a":0,"b":"0","c":false,"d":"false","e":true,"f":"true","g":1.5,"h":[1,"x y",false],"i":{"k":1},"j":null,"k":"","l":[],"m":{}}',
         ["--b", "0", "--d", "false", "--e", "--f", "true", "--g", "1.5", "--h", "1", "--h", "x y", "--h", "false", "--i", '{"k":1}']),
        ("{}", []), ('{"n":-0.0,"o":00}'.replace("00", "0"), []), (None, None), ('{"big":12345678901234567890}', ["--big", "12345678901234567890"]),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string")
    typed = df.select("i", F.from_json("t", "map<string,variant>").alias("o"))
    got = {r.i: r.a for r in typed.select("i", op.typed_arguments(F.col("o")).alias("a")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(rows)}
    some = typed.where("i = 0").select(op.typed_arguments(F.col("o"), ["e", "b", "zz"]).alias("a")).first().a
    assert some == ["--b", "0", "--e"]
    listed = op.option_inventory(typed.where("i = 0"), "o", ["i"], ["g"]).first()
    assert (listed.arguments, listed.words) == ("--g 1.5", 2)


def test_every_preference_against_plain_search(spark):
    """Many installs of few versions: each request is held against all installs in plain Python."""
    numbers = [(a, b, c) for a in (1, 2) for b in (0, 1, 2) for c in (0, 3, 11)]
    installs = [
        (f"/{i:03d}", "{}.{}.{}".format(*numbers[i * 7 % len(numbers)]), ver.EDITIONS[i % 3]) for i in range(120) if i % 18 != 5
    ] + [("/0", "x", None), ("/1", None, None)]
    asked = [(i, "{}.{}.{}".format(*n), e) for i, (n, e) in enumerate(
        [(n, e) for n in [*numbers, (2, 7, 0), (3, 0, 0), (1, 1, 5)] for e in (*ver.EDITIONS, None)])]
    asked += [(900, None, "enterprise"), (901, "rubbish", None)]
    have = [(tuple(map(int, v.split("."))), p, e or "community") for p, v, e in installs if v and v != "x"]

    def best(rows):
        top = max((k for k, *_ in rows), default=None)
        return min((p for k, p, _ in rows if k == top), default=None)

    stable = best([h for h in have if h[0][1] % 2 == 0])

    def expected(preference, version, edition):
        if version is None or preference in (ver.DEFAULT, ver.LATEST_STABLE):
            return stable
        if version == "rubbish":
            return None
        key, mine = tuple(map(int, version.split("."))), [h for h in have if h[2] == (edition or "community")]
        exact, near = best([h for h in mine if h[0] == key]), best([h for h in mine if h[0][:2] == key[:2]])
        return {ver.EXACT: exact, ver.LATEST_MINOR: near, ver.EXACT_OR_MINOR: exact or near,
                ver.MAJOR_GE: best([h for h in mine if h[0][0] >= key[0]])}[preference]

    table = spark.createDataFrame(installs, "path string, version string, edition string")
    requests = spark.createDataFrame(asked, "id int, version string, edition string")
    for preference in (ver.EXACT, ver.MAJOR_GE, ver.LATEST_STABLE, ver.EXACT_OR_MINOR, ver.LATEST_MINOR, ver.DEFAULT):
        got = {r.id: r.match_path for r in ver.match_versions(requests, table, preference).collect()}
        assert got == {i: expected(preference, v, e) for i, v, e in asked}, preference
