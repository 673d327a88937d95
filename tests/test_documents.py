"""Documents: files with comments, layers, references, edges, addresses."""

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from muster import schemas
from muster.operators import layers, lookup, refs, report
from muster.sources import arrays, documents

SERVERS = """
// servers of the test fleet
[
  /* no address */ {"_id": "s1", "cmdOptions": {"port": 28017, "fork": true, "list": [1, 2]}},
  {"_id": "s2", "_type": "Mongos", "address": "h2", "description": "zweiter Sérver"},
  {"_id": "s3", "_type": "ConfigMongod", "address": "h3:9"}, // own port
  {"_id": "s4", "_type": "Toaster", "address": "h4", "cmdOptions": {"port": 5}}
]
"""
CLUSTERS = """[
  {"_id": "rs", "replKey": "k", "members": [
     {"server": {"$ref": "servers", "$id": "s1"}, "priority": 0},
     {"server": {"$ref": "servers", "$id": "gone"}},
     {"host": "x:1", "arbiterOnly": true}, {"host": "a:b:1"}, {}]},
  {"_id": "sh", "_type": "ShardedCluster", "configServers": {"$ref": "clusters", "$id": "rs"},
   "shards": [{"cluster": {"$ref": "clusters", "$id": "rs"}}, {"server": {"$ref": "servers", "$id": "s3"}}],
   "members": [{"server": {"$ref": "servers", "$id": "s2"}}]},
  {"_id": "sh2", "_type": "ShardedCluster", "configServers": [
     {"server": {"$ref": "servers", "$id": "s1"}}, {"server": {"$ref": "servers", "$id": "s3"}}]}
]"""


def write(path, text):
    path.write_text(text)
    return str(path)


@pytest.fixture(scope="module")
def servers(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("conf")
    write(folder / "servers.config", SERVERS)
    return documents.read_documents(spark, "servers.config", schemas.SERVER, root=str(folder)).cache()


@pytest.fixture(scope="module")
def clusters(spark, tmp_path_factory):
    path = write(tmp_path_factory.mktemp("conf") / "clusters.config", CLUSTERS)
    return documents.read_documents(spark, path, schemas.CLUSTER).cache()


def test_comments_and_values(servers):
    rows = {r._id: r for r in servers.collect()}
    assert [rows[f"s{i}"].seq for i in range(1, 5)] == [0, 1, 2, 3]
    assert rows["s1"].cmdOptions == {"port": "28017", "fork": "true", "list": "[1,2]"}


@pytest.mark.parametrize("text", ["{}", "", '{"_id": "one"}', "// only a comment", "[{]"])
def test_only_arrays(spark, tmp_path, text):
    df = documents.read_documents(spark, write(tmp_path / "f.json", text or " "), "_id string")
    with pytest.raises(Exception):  # noqa: B017
        df.collect()


def test_empty_array_is_no_error(spark, tmp_path):
    assert documents.read_documents(spark, write(tmp_path / "f.json", "/* none */ []"), "_id string").count() == 0


def test_long_leading_comment(spark, tmp_path):
    text = "// x\n" * 20_000 + "/*" + "y" * 100_000 + "*/[" + '{"_id":"a"}]'
    assert documents.read_documents(spark, write(tmp_path / "f.json", text), "_id string").count() == 1


def plain_mask(text):
    """A reader of one character at a time."""
    out, at, state = [], 0, "code"
    while at < len(text):
        two = text[at : at + 2]
        if state == "code":
            state = "string" if two[:1] == '"' else "line" if two == "//" else "block" if two == "/*" else state
            width = 2 if state in ("line", "block") else 1
            out.append({"code": two[0], "string": "x"}.get(state, "  "))
        elif state == "string":
            width = len(two) if two[0] == "\\" else 1
            out.append("x" * width)
            state = "code" if two[0] == '"' else state
        else:
            ends = two[0] == "\n" if state == "line" else two == "*/"
            width = 2 if ends and state == "block" else 1
            out.append(" " * width)
            state = "code" if ends else state
        at += width
    return "".join(out), state


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet='[]{}",/*\\\na', max_size=40), st.integers(0, 4))
def test_the_effect_of_a_split(text, cuts):
    """Cut at any of its commas, a text is read by the states its parts hand on as it is in one go."""
    want, state = plain_mask(text + ",")
    pieces, rnd = (text + ",").split(",")[:-1], random.Random(cuts)
    joined = [pieces[0]]
    for piece in pieces[1:]:
        joined = [*joined, piece] if rnd.random() < 0.5 else [*joined[:-1], joined[-1] + "," + piece]
    got, now = b"", arrays.CODE
    for piece in joined:
        code, now = arrays.masked(piece.encode() + b",", now)
        got += code
    assert (got.decode(), now) == (want, ["code", "string", "line", "block"].index(state))


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "700b", "spark.sql.files.openCostInBytes": "1b"}
    before = {n: spark.conf.get(n) for n in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def nasty_documents(count):
    rnd, parts = random.Random(9), ['",', "//", "/*", "*/", "\\", '\\"', "[", "]{", "},", "\n", "é", ", ", "a"]
    for i in range(count):
        doc = {"_id": f"d{i}", "t": "".join(rnd.choice(parts) for _ in range(rnd.choice([0, 3, 30, 2000 if i % 50 == 7 else 5]))),
               "n": [i, {"k": ["x", i]}], "m": {"a,b": "]"}}
        text = json.dumps(doc, ensure_ascii=rnd.random() < 0.5, indent=rnd.choice([None, 1]))
        yield rnd.choice(["", " // one, \"two\" [ \n", "/* ] , \" * / */", "\n"]) + text + rnd.choice(["", " /* , */", "// ]\n"])


def test_large_files_in_splits(spark, tmp_path, small_splits):
    """Documents with commas, quotes, brackets and comment marks in their strings, between comments with all of these."""
    schema = "_id string, t string, n string, m map<string,string>"
    write(tmp_path / "a.json", "// [ one, \n/* { */ [" + ",".join(nasty_documents(400)) + "\n] // end, [")
    write(tmp_path / "b.json", "[" + ",".join(nasty_documents(7)) + "]\n")
    write(tmp_path / "c.json", " [ /* none, */ ]")

    def rows(whole_bytes):
        df = documents.read_documents(spark, [str(tmp_path / f"{n}.json") for n in "abc"], schema, whole_bytes=whole_bytes)
        return sorted((r.file, r.seq, r._id, r.t, r.n, tuple(sorted(r.m.items()))) for r in df.collect())

    want = rows(1 << 30)
    assert len(want) == 407
    assert rows(1) == want
    assert rows(3000) == want
    chunks = spark.read.option("lineSep", ",").text(str(tmp_path / "a.json"))
    assert chunks.rdd.getNumPartitions() > 50


@pytest.mark.parametrize("text", ["{}", " ", '{"_id": "one"}', "// only a comment, and", "[{]", '[{"_id":"a"},,{"_id":"b"}]', '[{"_id":"a"},]',
                                  '[{"_id":"a"}] x', '[{"_id":"a"}] [{"_id":"b"}]', "[1, 2]", '["_id', "[{}", "[]]"])
def test_only_arrays_in_splits(spark, tmp_path, text, small_splits):
    with pytest.raises(Exception):  # noqa: B017
        documents.read_documents(spark, write(tmp_path / "f.json", text), "_id string", whole_bytes=0).collect()


def test_later_layers_win(spark, servers):
    inline = spark.createDataFrame([('[{"_id":"s1","description":"inline"},{"_id":"s2","description":"a"},'
                                     '{"_id":"s2","description":"b"}]',)], "json string")
    second = documents.documents_from_json(inline, "json", "_id string, description string")
    stored = documents.documents_from_table(
        spark.createDataFrame([("s1", "stored", 0), (None, "no id", 1)], "_id string, description string, seq bigint"))
    files = servers.select("_id", "description", "seq")
    got = {r._id: r.description for r in layers.layer_documents([files, second, stored], "_id", "seq").collect()}
    assert got == {"s1": "stored", "s2": "b", "s3": None, "s4": None}


def test_types(servers, clusters):
    known, unknown = refs.type_servers(servers)
    assert {r._id: r.type for r in known.collect()} == {"s1": "server", "s2": "router", "s3": "server"}
    assert [r._id for r in unknown.collect()] == ["s4"]
    assert {r._id: r.type for r in refs.type_clusters(clusters)[0].collect()} == {
        "rs": "replica", "sh": "sharded", "sh2": "sharded"}


def test_edges_of_both_config_forms(clusters):
    got = {(r.cluster_id, r.role, r.pos, r.child_kind, r.child_id) for r in refs.edges(clusters).collect()}
    assert got == {
        ("rs", "members", 0, "server", "s1"), ("rs", "members", 1, "server", "gone"),
        ("sh", "members", 0, "server", "s2"), ("sh", "shards", 0, "cluster", "rs"), ("sh", "shards", 1, "server", "s3"),
        ("sh", "configServers", 0, "cluster", "rs"),
        ("sh2", "configServers", 0, "server", "s1"), ("sh2", "configServers", 1, "server", "s3"),
    }


def test_topology_reaches_three_levels(clusters):
    flat = refs.flatten_topology(refs.edges(clusters)).where("root = 'sh' AND role = 'shards'")
    assert {(r.shard, r.member_pos, r.server_id) for r in flat.collect()} == {
        ("rs", 0, "s1"), ("rs", 1, "gone"), ("s3", 0, "s3")}


def test_reverse_lookup_order(spark, servers, clusters):
    links = refs.edges(clusters)
    got = {r._id: (r.owner, r.owner_role) for r in refs.owners_of(servers.select("_id"), "_id", links).collect()}
    # config servers come before members, members before shards
    assert got == {"s1": ("sh2", "configServers"), "s2": ("sh", "members"), "s3": ("sh2", "configServers"), "s4": (None, None)}
    stored = refs.edges(clusters.where("_id = 'rs'"), F.lit("database"))
    both = refs.owners_of(servers.select("_id"), "_id", links.unionByName(stored))
    assert {r._id: r.owner for r in both.collect()}["s1"] == "rs"


def test_members_resolve(servers, clusters):
    port = F.try_element_at("cmdOptions", F.lit("port"))
    members = refs.explode_members(clusters).where("cluster_id = 'rs'").select(
        "pos", F.col("member.server.$id").alias("ref"), F.col("member.host").alias("host"))
    got = {r.pos: (r.label, r.server_address)
           for r in refs.resolve_refs(members, "ref", servers, "_id", F.col("address"), "host", port).collect()}
    bad = ("<Invalid Member>", None)
    assert got == {0: ("s1", None), 1: bad, 2: ("x:1", "x:1"), 3: bad, 4: bad}


def test_addresses(servers):
    port = F.try_element_at("cmdOptions", F.lit("port"))
    got = {r._id: (r.full_address, r.display_address)
           for r in refs.normalise_address(servers, "address", port).collect()}
    assert got == {"s1": (None, "localhost:28017"), "s2": ("h2:27017",) * 2, "s3": ("h3:9",) * 2, "s4": ("h4:5",) * 2}


def test_match_passes_through_arrays(clusters):
    def ids(query):
        return sorted(r._id for r in lookup.match_documents(clusters, query).select("_id").collect())

    assert ids({"members.server.$id": "s1"}) == ["rs"]
    assert ids({"$or": [{"shards.cluster.$id": "rs"}, {"replKey": "k"}]}) == ["rs", "sh"]
    assert ids({"replKey": None, "_type": "ShardedCluster"}) == ["sh", "sh2"]
    assert ids({"nothing.here": 1}) == []


def test_listing_and_show(servers):
    rows = report.listing(servers, "_id", {"description": F.col("description")}).collect()
    assert [(r._id, r.description) for r in rows] == [("s1", ""), ("s2", "zweiter Srver"), ("s3", ""), ("s4", "")]
    assert '"_id" : "s2"' in report.show(servers.select("_id", "address"), "_id", "s2").first().document
    with pytest.raises(Exception, match="no document"):
        report.show(servers.select("_id"), "_id", "nope").collect()
