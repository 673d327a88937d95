"""One query per operator, over the whole test tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.functions import text as tx
from muster.functions import versions as vs
from muster.functions.durations import humanise_seconds, micros
from muster.operators import activity as act
from muster.operators import addresses as addr
from muster.operators import health, layers, lookup, options, reconcile, refs, report, texts
from muster.operators import versions as ver
from muster.operators.ordered import count_pieces, ordered_concat
from muster.plans import fleet_view as fleet
from muster.plans.configure import configuration_plan
from muster.plans.export_source import export_sources
from muster.plans.log_files import write_logs
from muster.session import materialise, scratch_path, tune
from muster.sources import activity as activity_source
from muster.sources import documents, logs, snapshots
from muster.streaming import feeds

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
LATE_SECONDS = 6 * 3600


def query(fn: Query) -> Query:
    @wraps(fn)
    def tuned(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(tune(spark), sf_dir)

    QUERIES[fn.__name__] = tuned
    return tuned


def col(name: str) -> Column:
    return F.col(name)


def text(value: Column) -> Column:
    return value.cast("string")


# ---- sources and sinks -------------------------------------------------------------------------

def _document_files(spark: SparkSession, sf_dir: str) -> str:
    """Supplier documents as commented JSON array files of at most 1000 suppliers each."""
    path = scratch_path(spark, "documents")
    doc = F.to_json(
        F.struct(
            text(col("s_suppkey")).alias("_id"),
            col("s_name").alias("address"),
            F.struct((col("s_suppkey") + 27000).alias("port")).alias("cmdOptions"),
        )
    )
    (
        fleet.table(spark, sf_dir, "supplier")
        .select(F.floor(col("s_suppkey") / 1000).alias("file"), F.struct("s_suppkey", doc.alias("doc")).alias("d"))
        .groupBy("file")
        .agg(F.sort_array(F.collect_list("d")).alias("docs"))
        .select(
            "file",
            F.concat(
                F.lit("// servers\n[ /* one per supplier */ "),
                F.array_join(F.transform("docs", lambda d: d["doc"]), ",\n"),
                F.lit("]"),
            ).alias("value"),
        )
        .write.partitionBy("file")
        .text(path)
    )
    return path


@query
def read_documents(spark, sf_dir):
    docs = documents.read_documents(
        spark, _document_files(spark, sf_dir), "_id string, address string, cmdOptions map<string,string>"
    )
    return docs.select("_id", "address", F.try_element_at("cmdOptions", F.lit("port")).alias("port"))


@query
def inline_documents(spark, sf_dir):
    def doc(kind: str) -> Column:
        return F.to_json(F.struct(F.concat(F.lit(kind), text(col("c_custkey"))).alias("_id"), col("c_name").alias("description")))

    inline = fleet.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("/* inline */ ["), doc("a"), F.lit(","), doc("b"), F.lit("]")).alias("json")
    )
    return documents.documents_from_json(inline, "json", "_id string, description string")


@query
def stored_documents(spark, sf_dir):
    stored = fleet.table(spark, sf_dir, "supplier").select(
        text(col("s_suppkey")).alias("_id"),
        F.when(col("s_acctbal") < 0, "Proxy").when(col("s_acctbal") < 5000, "Mongos").alias("_type"),
    )
    known, unknown = refs.type_servers(documents.documents_from_table(stored))
    return known.select("_id", "type").unionByName(unknown.select("_id", F.lit("rejected").alias("type")))


@query
def record_activity(spark, sf_dir):
    path = scratch_path(spark, "activity")
    records = activity_source.activity_records(fleet.events(spark, sf_dir), "event_type", "ts", "user_id")
    activity_source.record_activity(records, path)
    return (
        activity_source.read_activity(spark, path)
        .groupBy("op", text(col("dt")).alias("dt"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log per user: a record per event, and two more lines (a traceback) after each error."""
    header = logs.format_line(F.upper("event_type"), col("ts"), col("props"))
    line = col("event_id") * 3
    lines = F.when(
        col("event_type") == "error",
        F.array(
            F.struct(line.alias("line"), header.alias("value")),
            F.struct((line + 1).alias("line"), F.lit("Traceback (most recent call last):").alias("value")),
            F.struct((line + 2).alias("line"), F.concat(F.lit("  value "), col("user_id")).alias("value")),
        ),
    ).otherwise(F.array(F.struct(line.alias("line"), header.alias("value"))))
    return fleet.events(spark, sf_dir).select(
        F.concat(F.lit("user-"), col("user_id")).alias("file"), F.inline(lines)
    )


@query
def parse_log(spark, sf_dir):
    parsed = logs.parse_log(_log_lines(spark, sf_dir))
    return parsed.withColumn("ts", F.date_format("ts", logs.TIME_FORMAT))


@query
def tail(spark, sf_dir):
    turns = fleet.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return logs.tail(turns, ["conv_id"], ["turn"], 3)


@query
def snapshot_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "orders")
    orders = fleet.table(spark, sf_dir, "orders")
    snapshots.export_snapshot(orders, path, {"o_orderstatus": "F"}, ["o_orderpriority"])
    back = snapshots.read_snapshot(spark, path, col("o_totalprice") > 100000)
    return back.select("o_orderkey", text(col("o_orderpriority")).alias("o_orderpriority"), "o_totalprice")


@query
def export_manifest(spark, sf_dir):
    lines = fleet.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus")
    out = snapshots.export_snapshot(
        lines, scratch_path(spark, "lines"), {"$or": [{"l_linestatus": "F"}, {"l_returnflag": "N"}]},
        ["l_returnflag", "l_linestatus"],
    )
    return out.select(text(col("l_returnflag")).alias("flag"), text(col("l_linestatus")).alias("status"), "rows")


@query
def import_snapshot(spark, sf_dir):
    src, dest, rejects = (scratch_path(spark, n) for n in ("src", "dest", "rejects"))
    docs = fleet.table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    snapshots.export_snapshot(docs, src)
    snapshots.import_snapshot(
        spark, src, dest, schema="doc_id bigint, lang string, n_chars bigint",
        check=col("n_chars") >= 400, stop_on_error=False, rejects=rejects,
    )
    loaded = spark.read.parquet(dest).withColumn("outcome", F.lit("loaded"))
    return loaded.unionByName(spark.read.parquet(rejects).withColumn("outcome", F.lit("rejected"))).drop("load")


@query
def replay_changes(spark, sf_dir):
    base = fleet.table(spark, sf_dir, "supplier").select(
        col("s_suppkey").alias("key"), col("s_acctbal").alias("value")
    )
    log = fleet.events(spark, sf_dir).where(col("event_type").isin("purchase", "signup", "error")).select(
        col("user_id").alias("key"),
        F.when(col("event_type") == "error", "delete").otherwise("upsert").alias("op"),
        "ts", "event_id", "value",
    )
    until = col("ts") <= F.lit("2024-01-20").cast("timestamp")
    return snapshots.replay_changes(base, log, "key", "op", ["ts", "event_id"], ["value"], until)


# ---- filters and lookups -----------------------------------------------------------------------

@query
def match_documents(spark, sf_dir):
    def ref(key: Column) -> Column:
        return F.struct(F.struct(key.alias("$id")).alias("server"))

    docs = fleet.members(spark, sf_dir).select(
        "cluster", "state", "line", F.array(ref(col("server")), ref(col("part"))).alias("members")
    )
    found = lookup.match_documents(
        docs, {"state": "PRIMARY", "$or": [{"members.server.$id": 5}, {"members.server.$id": 7}]}
    )
    return found.select("cluster", "line", "state")


@query
def classify_targets(spark, sf_dir):
    user = text(col("user_id"))
    kind = col("event_type")
    target = (
        F.when(kind == "view", user)
        .when(kind == "error", F.concat_ws("/", user, kind, user))
        .when(kind == "signup", F.concat(F.lit("mongodb://"), user, F.lit(":27017/db")))
        .when(kind == "purchase", F.concat(F.lit("x"), user))
        .otherwise(F.concat_ws("/", user, kind))
    )
    targets = fleet.events(spark, sf_dir).select("event_id", target.alias("target"))
    paths = fleet.table(spark, sf_dir, "nation").select(text(col("n_nationkey")).alias("path")).unionByName(
        fleet.table(spark, sf_dir, "customer").select(F.concat(F.lit("x"), col("c_nationkey")).alias("path"))
    )
    out = lookup.classify_targets(
        targets, "target",
        fleet.table(spark, sf_dir, "supplier"), "s_suppkey",
        fleet.table(spark, sf_dir, "customer"), "c_custkey",
        paths,
    )
    return out.select("event_id", "target_id", "database", "kind")


@query
def any_member(spark, sf_dir):
    return lookup.any_member(fleet.members(spark, sf_dir), ["cluster"], col("config"), "has_config")


@query
def pick_first(spark, sf_dir):
    return lookup.pick_first(
        fleet.members(spark, sf_dir), ["cluster"], fleet.ORDER,
        (col("state") == "PRIMARY") & ~col("arbiter"), ["server", "line", "part"],
    )


@query
def suggest_primary(spark, sf_dir):
    resolved = refs.resolve_refs(
        fleet.members(spark, sf_dir), "server", fleet.servers(spark, sf_dir), "server", col("address")
    )
    return lookup.suggest_primary(
        resolved, ["cluster"], fleet.ORDER, ~col("arbiter") & ~col("passive"),
        col("server_address").isNotNull(), col("config"), ["server", "server_address"],
    )


@query
def first_config(spark, sf_dir):
    readable = F.when(col("quantity") > 25, col("part"))
    members = fleet.members(spark, sf_dir).withColumn("conf", readable)
    primary = (col("state") == "PRIMARY") & col("passive")
    return lookup.first_config(members, ["cluster"], fleet.ORDER, "conf", primary, col("arbiter"))


@query
def first_source(spark, sf_dir):
    holdings = fleet.members(spark, sf_dir).where("config").select("part", col("server").alias("source"))
    requests = fleet.table(spark, sf_dir, "part").select(col("p_partkey").alias("part"))
    return lookup.first_source(requests, holdings, ["part"], "source", "source")


# ---- layering and maps -------------------------------------------------------------------------

@query
def layer_documents(spark, sf_dir):
    def layer(table: str, key: str, name: str, seq: str) -> DataFrame:
        return fleet.table(spark, sf_dir, table).select(
            col(key).alias("key"), text(col(name)).alias("name"), col(seq).alias("seq")
        )

    stacked = [
        layer("customer", "c_custkey", "c_name", "c_custkey"),
        layer("supplier", "s_suppkey", "s_name", "s_suppkey"),
        layer("orders", "o_custkey", "o_orderpriority", "o_orderkey"),
    ]
    return layers.layer_documents(stacked, "key", "seq").select("key", "name", col("layer").cast("bigint").alias("layer"))


@query
def merge_settings(spark, sf_dir):
    current = F.create_map(F.lit("a"), col("o_orderstatus"), F.lit("b"), col("o_orderpriority"))
    declared = F.when(
        col("o_totalprice") > 100000, F.create_map(F.lit("b"), F.lit("x"), F.lit("c"), col("o_orderstatus"))
    )
    docs = fleet.table(spark, sf_dir, "orders").select("o_orderkey", current.alias("now"), declared.alias("declared"))
    return docs.select(
        "o_orderkey",
        layers.settings_text(layers.merge_settings(col("now"), col("declared"))).alias("settings"),
        layers.settings_text(layers.override_options(col("now"), col("declared"))).alias("options"),
    )


@query
def gate_options(spark, sf_dir):
    base = {"authenticationDatabase": "admin", "restoreDbUsersAndRoles": "true"}
    pairs = [F.lit(t) for kv in base.items() for t in kv]
    given = F.when(
        col("edition") == "enterprise", F.create_map(*pairs, F.lit("continueOnError"), F.lit("true"))
    ).otherwise(F.create_map(*pairs))
    docs = fleet.installs(spark, sf_dir).select("path", "version", given.alias("options"))
    gated = options.gate_options(docs, "options", "version", options.IMPORT_GATES)
    return gated.select("path", layers.settings_text(col("options")).alias("options"))


@query
def export_options(spark, sf_dir):
    given = F.create_map(*[F.lit(t) for t in ("authenticationDatabase", "admin", "dumpDbUsersAndRoles", "true", "out", "/d")])
    docs = fleet.installs(spark, sf_dir).select("path", "version", given.alias("options"))
    gated = options.gate_options(docs, "options", "version", options.EXPORT_GATES)
    return gated.select("path", layers.settings_text(col("options")).alias("options"))


@query
def restore_version(spark, sf_dir):
    version = F.concat(F.lit("3."), col("c_custkey") % 2, F.lit("."), col("c_nationkey") % 10)
    wanted, preference = ver.restore_request(version)
    return fleet.table(spark, sf_dir, "customer").select("c_custkey", wanted.alias("version"), preference.alias("preference"))


@query
def config_addresses(spark, sf_dir):
    """Config servers per nation: a replica in even nations, a plain list in odd ones."""
    return report.replica_addresses(
        fleet.servers(spark, sf_dir), "nation", ["server"], [count_pieces(col("server"))], col("address"),
        replica=col("nation") % 2 == 0,
    )


@query
def role_options(spark, sf_dir):
    given = F.create_map(
        F.lit("keyFile"), F.lit("/key"), F.lit("wiredTigerCacheSizeGB"), text(col("quantity") / 4),
        F.lit("port"), text(col("server") + 27000),
    )
    replica = F.when(~col("passive"), F.concat(F.lit("c"), col("cluster")))
    docs = fleet.members(spark, sf_dir).withColumn("options", given)
    chosen = options.role_options(
        docs, "options", replica, col("state") == "SECONDARY", col("config"), col("arbiter")
    )
    return chosen.select("cluster", "line", "part", layers.settings_text(col("options")).alias("options"))


@query
def option_inventory(spark, sf_dir):
    status = col("o_orderstatus")
    given = F.create_map(
        F.lit("shardsvr"), F.when(status == "F", "true").otherwise("false"),
        F.lit("port"), F.when(status == "O", "0").otherwise(text(col("o_custkey"))),
        F.lit("setParameter"), F.to_json(F.array("o_orderpriority", "o_orderstatus")),
        F.lit("secret"), F.lit("x"),
    )
    docs = fleet.table(spark, sf_dir, "orders").select("o_orderkey", given.alias("options"))
    out = options.option_inventory(docs, "options", ["o_orderkey"], ["shardsvr", "port", "setParameter"])
    return out.withColumn("words", col("words").cast("bigint"))


@query
def typed_option_inventory(spark, sf_dir):
    """Options as they stand in a JSON document: numbers and flags go where they are zero or false, the same texts stay."""
    status = col("o_orderstatus")
    number = col("o_custkey") % 3
    given = F.concat(
        F.lit('{"port":'), text(number), F.lit(',"portText":"'), text(number), F.lit('","ratio":'), text(number), F.lit(".0"),
        F.lit(',"shardsvr":'), F.when(status == "F", "true").otherwise("false"), F.lit(',"flagText":"false"'),
        F.lit(',"none":null,"empty":"","noItems":[],"setParameter":["'), status, F.lit('",0,true]}'),
    )
    docs = fleet.table(spark, sf_dir, "orders").select("o_orderkey", F.from_json(given, "map<string,variant>").alias("options"))
    out = options.option_inventory(docs, "options", ["o_orderkey"])
    return out.withColumn("words", col("words").cast("bigint"))


# ---- joins -------------------------------------------------------------------------------------

@query
def cluster_edges(spark, sf_dir):
    return refs.edges(fleet.cluster_documents(spark, sf_dir))


@query
def explode_members(spark, sf_dir):
    exploded = refs.explode_members(fleet.cluster_documents(spark, sf_dir), "_id", "shards")
    return exploded.select(
        "cluster_id", "pos", col("member.server.$id").alias("server_id"), col("member.cluster.$id").alias("shard_id")
    )


@query
def resolve_refs(spark, sf_dir):
    members = fleet.members(spark, sf_dir).select(
        "cluster", "line", "part",
        F.when(~col("passive"), col("server")).alias("ref"),
        F.when(col("config"), F.concat(F.lit("h"), col("server"), F.lit(":1"))).otherwise("bad").alias("host"),
    )
    known = fleet.servers(spark, sf_dir).where(col("balance") >= 0)
    out = refs.resolve_refs(members, "ref", known, "server", col("address"), "host")
    return out.select("cluster", "line", "part", "label", "server_address")


def _role_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.when(col("config"), "configServers").when(col("arbiter"), "shards").otherwise("members")
    return fleet.members(spark, sf_dir).select(
        col("cluster").alias("cluster_id"), role.alias("role"), col("line").alias("pos"),
        F.lit("server").alias("child_kind"), col("server").alias("child_id"),
        F.when(col("state") == "PRIMARY", "file").otherwise("database").alias("source"),
    )


@query
def owners_of(spark, sf_dir):
    files = _role_edges(spark, sf_dir).where(col("source") == "file")
    return refs.owners_of(fleet.servers(spark, sf_dir).select("server"), "server", files)


@query
def owners_by_source(spark, sf_dir):
    parts = fleet.table(spark, sf_dir, "part").select(col("p_partkey").alias("server"))
    links = _role_edges(spark, sf_dir).drop("child_id").withColumn("child_id", col("cluster_id"))
    return refs.owners_of(parts, "server", links)


@query
def topology(spark, sf_dir):
    flat = refs.flatten_topology(fleet.topology_edges(spark, sf_dir))
    return flat.select("root", "role", "shard", "shard_pos", "member_pos", "server_id")


@query
def topology_addresses(spark, sf_dir):
    flat = refs.flatten_topology(fleet.topology_edges(spark, sf_dir)).where(col("server_id").isNotNull())
    servers = fleet.servers(spark, sf_dir).select(text(col("server")).alias("server_id"), "address")
    return report.replica_addresses(
        flat.join(servers, "server_id"), "shard", ["member_pos"], [count_pieces(col("member_pos"))], col("address")
    )


@query
def cluster_uri(spark, sf_dir):
    resolved = refs.resolve_refs(
        fleet.members(spark, sf_dir), "server", fleet.servers(spark, sf_dir), "server", col("address")
    )
    auth = lookup.any_member(fleet.members(spark, sf_dir), ["cluster"], col("config"), "auth")
    return report.cluster_uri(
        resolved, "cluster", fleet.ORDER, fleet.split(), col("server_address"), ~col("arbiter"), auth=auth,
        hot=fleet.hot_clusters(spark, sf_dir),
    )


@query
def server_uri(spark, sf_dir):
    return fleet.servers(spark, sf_dir).select(
        "server", report.server_uri(col("address"), col("balance") > 0).alias("uri")
    )


@query
def member_roles(spark, sf_dir):
    links = fleet.table(spark, sf_dir, "orders").select(
        F.lit("cluster").alias("child_kind"), col("o_orderkey").alias("child_id"),
        F.when(col("o_orderstatus") == "F", "configServers").when(col("o_orderstatus") == "O", "shards")
        .otherwise("members").alias("role"),
    )
    out = refs.member_roles(
        fleet.members(spark, sf_dir), "cluster", "server", col("arbiter"), F.when(col("passive"), 0), links, col("config")
    )
    return out.select(
        "cluster", "line", "part", "is_arbiter", "is_passive", "can_become_primary", "in_connection",
        "is_config_server", "is_shard_server",
    )


@query
def match_addresses(spark, sf_dir):
    orders = fleet.table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderstatus", F.concat_ws(":", "o_orderkey", "o_custkey").alias("address")
    )
    hosts = fleet.members(spark, sf_dir).select(col("cluster").alias("host"), col("server").alias("ip")).distinct()
    found = addr.match_addresses(
        orders.where(col("o_orderstatus") == "F"), ["o_orderkey"], col("address"),
        orders.where(col("o_orderstatus") == "P"), ["o_orderkey"], ["o_orderkey"], col("address"), hosts=hosts,
    )
    return found.select("o_orderkey", col("match.o_orderkey").alias("same_as"))


@query
def enrich_status(spark, sf_dir):
    status = fleet.members(spark, sf_dir).select("cluster", "line", col("part").alias("name"))
    config = fleet.table(spark, sf_dir, "part").select(
        col("p_partkey").alias("host"), col("p_size").alias("priority"),
        F.when(col("p_type") == "SMALL", 1).otherwise(0).alias("votes"),
        (col("p_type") == "PROMO").alias("hidden"),
        F.when(col("p_size") > 40, col("p_size").cast("bigint")).alias("slaveDelay"),
    )
    return health.enrich_status(status, config, ["name"], ["host"])


# ---- reconciliation ----------------------------------------------------------------------------

@query
def validate_members(spark, sf_dir):
    quantity, server = col("quantity"), col("server")
    members = fleet.members(spark, sf_dir).select(
        "cluster", "line", "part",
        F.when(quantity <= 40, server).alias("ref"),
        F.when(quantity > 48, None).when(quantity > 44, F.concat(F.lit("h"), server))
        .when(quantity > 30, F.concat(F.lit("h"), server, F.lit(":1"))).alias("host"),
        F.when(col("config") & (col("line") == 7), "x.y").otherwise("3.2.0").alias("version"),
    )
    known = fleet.servers(spark, sf_dir).where(col("balance") >= 0)
    resolved = refs.resolve_refs(members, "ref", known, "server", F.when(col("balance") < 9000, col("address")), "host")
    out = reconcile.validate_members(
        resolved, col("ref"), col("host"), col("server_id"), col("server_address"), col("version")
    )
    return out.select("cluster", "line", "part", F.array_join("errors", ",").alias("errors"))


@query
def validate_servers(spark, sf_dir):
    docs = fleet.installs(spark, sf_dir).select(
        "path",
        F.when(col("edition") == "community", F.concat(F.lit("x"), col("version"))).otherwise(col("version")).alias("mongoVersion"),
        F.create_map(
            F.when(col("edition") == "enterprise", "PATH").otherwise("TCMALLOC_AGGRESSIVE_DECOMMIT"), F.lit("y")
        ).alias("environmentVariables"),
    )
    out = reconcile.validate_servers(docs, environment="environmentVariables")
    return out.select("path", F.array_join("errors", ",").alias("errors"))


@query
def validate_clusters(spark, sf_dir):
    docs = fleet.cluster_documents(spark, sf_dir)
    out = reconcile.validate_clusters(docs, refs.edges(docs))
    return out.select("_id", F.array_join("errors", ",").alias("errors"))


def _clashing(spark: SparkSession, sf_dir: str, hot: DataFrame) -> DataFrame:
    return fleet.placed_members(spark, sf_dir, hot).select(
        "cluster", "pos", "config", "line", (col("line") - 1).alias("id"),
        F.when(~col("arbiter"), col("server")).alias("server"),
        F.concat_ws(":", "server", "line").alias("address"),
    )


@query
def find_conflicts(spark, sf_dir):
    hot = fleet.hot_clusters(spark, sf_dir)
    return reconcile.find_conflicts(
        _clashing(spark, sf_dir, hot), "cluster", "pos", col("id"), col("server"), col("address"), hot=hot
    )


@query
def first_conflict(spark, sf_dir):
    return reconcile.first_conflict(find_conflicts(spark, sf_dir), "cluster", "pos")


def _current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current configuration: one of the ``config`` lines per order and line number."""
    last = F.max(F.struct(*[c for c in fleet.ORDER if c != "line"])).alias("_m")  # holds the server and the part
    return fleet.members(spark, sf_dir).where("config").groupBy("cluster", "line").agg(last).select(
        "cluster", col("line").alias("id"), col("line").alias("at"),
        F.concat(F.lit("s"), col("_m.server"), F.lit(":1")).alias("host"),
    )


@query
def find_drift(spark, sf_dir):
    declared = materialise(fleet.placed_members(spark, sf_dir).where(~col("config")).select(
        "cluster", "pos", col("line").alias("id"), F.concat(F.lit("s"), col("server"), F.lit(":1")).alias("address")
    ), "declared")
    out = reconcile.find_drift(
        declared, materialise(_current(spark, sf_dir), "current"), "cluster", "pos", "id", col("address"), col("host")
    )
    return out.select("cluster", "pos", "kind", "current_id")


@query
def assign_ids(spark, sf_dir):
    declared = materialise(fleet.placed_members(spark, sf_dir).select(
        "cluster", "pos", F.when(col("line") > 4, col("line")).alias("given"),
        F.concat(F.lit("s"), col("server"), F.lit(":1")).alias("address"),
    ), "declared")
    out = reconcile.assign_ids(
        declared, materialise(_current(spark, sf_dir), "current"), "cluster", "pos", "given", col("address"), col("host"),
        [count_pieces(col("pos"))], hot=fleet.hot_clusters(spark, sf_dir),
    )
    return out.select("cluster", "pos", "member_id")


@query
def build_desired(spark, sf_dir):
    declared = fleet.placed_members(spark, sf_dir)
    current = _current(spark, sf_dir).select("cluster", col("at").alias("pos"), "host", "id")
    tags = reconcile.alternate_tags(
        F.when(col("passive"), F.create_map(F.lit("dc"), F.lit("east"))), F.concat(F.lit("s"), col("server")),
        col("arbiter"), {"alt": F.concat(F.lit("s"), col("part"))},
    )
    desired = reconcile.build_desired(
        declared, current, "cluster", "pos", F.concat(F.lit("s"), col("server")), tags=tags, add=col("passive")
    )
    item = F.concat(F.col("host"), F.lit("/"), F.coalesce(layers.settings_text(col("tags")), F.lit("")))
    return ordered_concat(
        desired, ["cluster"], ["turn", "pos"], [col("turn"), count_pieces(col("pos"))], item, "members", " ",
        hot=fleet.hot_clusters(spark, sf_dir),
    )


def _header(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = fleet.table(spark, sf_dir, "orders").select(
        col("o_orderkey").alias("cluster"), "o_orderstatus", "o_totalprice"
    )
    current = fleet.members(spark, sf_dir).groupBy("cluster").agg(
        F.count(F.lit(1)).alias("version"), F.create_map(F.lit("a"), text(F.max("line"))).alias("settings")
    )
    declared = F.when(col("o_totalprice") > 250000, F.create_map(F.lit("b"), col("o_orderstatus")))
    out = reconcile.desired_header(orders, current, "cluster", declared, col("o_orderstatus") == "F")
    return out.withColumn("settings", layers.settings_text(col("settings")))


@query
def desired_header(spark, sf_dir):
    return _header(spark, sf_dir)


def _to_configure(spark: SparkSession, sf_dir: str, hot: DataFrame) -> DataFrame:
    """Declared members with the errors of each by itself; passive ones ask for another id than they have."""
    quantity, server = col("quantity"), col("server")
    members = fleet.placed_members(spark, sf_dir, hot).select(
        "cluster", "pos", F.when(col("config"), col("line") + F.when(col("passive"), 1).otherwise(0)).alias("id"),
        "server", "passive", F.when(quantity < 49, server).alias("ref"),
        F.when(quantity == 49, F.concat(F.lit("h"), server)).alias("named"),
    )
    known = fleet.servers(spark, sf_dir).where(col("balance") >= -900)
    resolved = refs.resolve_refs(members, "ref", known, "server", col("address"), "named")
    checked = reconcile.validate_members(resolved, col("ref"), col("named"), col("server_id"), col("server_address"))
    return checked.select(
        "cluster", "pos", "id", "server", F.concat(F.lit("s"), server, F.lit(":1")).alias("address"), "passive", "errors"
    )


@query
def configuration_dry_run(spark, sf_dir):
    hot = fleet.hot_clusters(spark, sf_dir)
    return configuration_plan(
        _to_configure(spark, sf_dir, hot), materialise(_current(spark, sf_dir), "current"), "cluster", "pos", "id",
        col("address"), col("server"), col("host"), [count_pieces(col("pos"))], keep=["passive"],
        hot=hot, errors=col("errors"), header=_header(spark, sf_dir),
    )


@query
def configuration_rejects(spark, sf_dir):
    hot = fleet.hot_clusters(spark, sf_dir)
    return reconcile.configuration_rejects(
        materialise(_to_configure(spark, sf_dir, hot), "declared"), materialise(_current(spark, sf_dir), "current"),
        "cluster", "pos", "id", col("server"), col("address"), col("host"), col("errors"), hot=hot,
    )


@query
def plan_additions(spark, sf_dir):
    declared = fleet.table(spark, sf_dir, "documents").select("doc_id", "source")
    return reconcile.plan_additions(declared, fleet.table(spark, sf_dir, "labels"), ["doc_id"])


@query
def already_listed(spark, sf_dir):
    declared = fleet.table(spark, sf_dir, "documents").select("doc_id", "source")
    return reconcile.already_listed(declared, fleet.table(spark, sf_dir, "labels"), ["doc_id"])


@query
def plan_relocation(spark, sf_dir):
    holdings = fleet.table(spark, sf_dir, "supplier").join(
        fleet.table(spark, sf_dir, "nation"), col("s_nationkey") == col("n_nationkey")
    ).select(col("s_name").alias("database"), col("n_regionkey").alias("shard"))
    moves = fleet.table(spark, sf_dir, "region").where(col("r_name").isin("AFRICA", "EUROPE")).select(
        col("r_regionkey").alias("shard"),
        F.when(col("r_name") == "AFRICA", 1).otherwise(99).alias("destination"),
    )
    return reconcile.plan_relocation(holdings, moves, fleet.table(spark, sf_dir, "region"), "shard", "r_regionkey")


@query
def verify_applied(spark, sf_dir):
    expected = fleet.table(spark, sf_dir, "orders").select(
        col("o_orderkey").alias("cluster"),
        F.substring("o_orderpriority", 1, 1).cast("bigint").alias("expected"),
        (col("o_orderstatus") == "F").alias("forced"),
    )
    observed = fleet.members(spark, sf_dir).groupBy("cluster").agg(F.count(F.lit(1)).alias("observed"))
    return reconcile.verify_applied(expected, observed, ["cluster"], "expected", "observed", col("forced"))


@query
def verify_cache_size(spark, sf_dir):
    gib = col("o_totalprice") / 65536
    seen = F.when(col("o_orderstatus") == "F", F.lit(1)).otherwise(tx.gib_to_bytes(gib))
    return fleet.table(spark, sf_dir, "orders").select(
        "o_orderkey", reconcile.cache_size_applied(gib, col("o_orderpriority") != "1-URGENT", seen).alias("applied")
    )


# ---- health ------------------------------------------------------------------------------------

@query
def latest_snapshot(spark, sf_dir):
    return health.latest_snapshot(
        fleet.events(spark, sf_dir), ["user_id"], ["ts", "event_id"], ["event_id", "event_type", "value"]
    )


@query
def status_summary(spark, sf_dir):
    event = col("event_type")
    status = fleet.events(spark, sf_dir).select(
        text(col("user_id")).alias("server"), "ts", col("event_id").alias("seq"), (event != "error").alias("connection"),
        F.when(event == "error", F.concat(F.lit("Timed Out after "), col("user_id"))).alias("error"),
        F.concat(F.lit("h"), col("user_id")).alias("host"), event.alias("version"),
        F.struct(col("event_id").alias("current"), F.lit(9).cast("bigint").alias("available"),
                 F.lit(1).cast("bigint").alias("totalCreated")).alias("connections"),
    )
    return health.status_summary(status).select(
        "server", "host", "version", "connection", "error", "timedOut", F.to_json("connections").alias("connections")
    )


@query
def classify_outcome(spark, sf_dir):
    rules = [("secret", ["token ="]), ("address", ["@"]), ("license", ["license"])]
    docs = fleet.table(spark, sf_dir, "documents").select("text")
    return health.classify_outcome(docs, "text", rules).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query
def start_outcome(spark, sf_dir):
    error = F.when(col("event_type") != "view", F.concat_ws(
        " ",
        F.when(col("value") > 100, "Timed Out"),
        F.when(col("event_type") == "error", "connection closed"),
        F.when(col("event_type") == "click", "SSL handshake failed"),
        F.when(col("event_type") == "purchase", "refused"),
    ))
    df = fleet.events(spark, sf_dir).select("event_id", error.alias("error"))
    df = health.classify_outcome(df, "error", health.START_RULES, name="at_start")
    df = health.classify_outcome(df, "error", health.STOP_RULES, name="at_stop")
    return health.classify_outcome(df, "error", health.ONLINE_RULES, "online", "online").drop("error")


def _leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.pick_first(
        fleet.members(spark, sf_dir), ["cluster"], fleet.ORDER, (col("state") == "PRIMARY") & ~col("arbiter"),
        [col("server").alias("leader"), col("optime").alias("leader_optime"), col("line").alias("leader_line"),
         col("part").alias("leader_part"), col("price").alias("leader_price")],
    )


@query
def lag_to_leader(spark, sf_dir):
    out = health.lag_to_leader(
        fleet.members(spark, sf_dir), _leaders(spark, sf_dir), ["cluster"], "optime", "leader_optime",
        (col("state") == "SECONDARY") & ~col("arbiter"),
    )
    return out.select("cluster", "line", "part", "lag", "missing_leader")


def _sources(spark: SparkSession, sf_dir: str, **kwargs) -> DataFrame:
    usable = ~col("arbiter")
    return export_sources(
        fleet.members(spark, sf_dir), ["cluster"], fleet.ORDER, "server", "optime",
        (col("state") == "PRIMARY") & usable, (col("state") == "SECONDARY") & usable, "passive", **kwargs,
    )


@query
def rank_candidates(spark, sf_dir):
    return _sources(spark, sf_dir)


@query
def rank_candidates_within_lag(spark, sf_dir):
    return _sources(spark, sf_dir, max_lag=365 * 86400.0, k=2)


@query
def retention_span(spark, sf_dir):
    users = fleet.table(spark, sf_dir, "customer").select(col("c_custkey").alias("user_id"))
    changes = fleet.events(spark, sf_dir)
    return health.retention_span(changes, ["user_id"], F.floor(micros(col("ts")) / 1000000), users)


def _is_leader() -> Column:
    return (
        (col("server") == col("leader")) & (col("line") == col("leader_line")) & (col("part") == col("leader_part"))
        & (col("price") == col("leader_price"))
    )


@query
def cluster_status(spark, sf_dir):
    out = health.cluster_status(
        fleet.members(spark, sf_dir), _leaders(spark, sf_dir), ["cluster"], "optime", "leader_optime", _is_leader()
    )
    return out.select(
        "cluster", "leader", "others", F.date_format("newest_other", "yyyy-MM-dd").alias("newest_other"), "behind",
        "largest_lag", "missing_leader",
    )


def _member_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet.members(spark, sf_dir).select(
        col("cluster").alias("cluster_id"), text(col("part")).alias("name"),
        F.when(col("arbiter"), "ARBITER").otherwise(col("state")).alias("stateStr"),
        (col("line") == 1).alias("is_self"), col("optime").cast("timestamp").alias("optimeDate"),
        F.when(col("config"), "x").otherwise("").alias("errmsg"), *fleet.ORDER,
    )


def _member_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings that follow from the address, so that members listed twice have one config row."""
    part = col("part")
    return fleet.members(spark, sf_dir).select("cluster", "part").distinct().select(
        col("cluster").alias("cluster_id"), text(part).alias("host"), (part % 3).cast("int").alias("priority"),
        F.when(part % 7 == 0, 0).otherwise(1).alias("votes"), (part % 5 == 0).alias("hidden"),
        F.when(part % 11 == 0, F.lit(60).cast("bigint")).alias("slaveDelay"),
        F.when(part % 4 == 0, F.create_map(F.lit("dc"), F.lit("east"))).alias("tags"),
    )


@query
def cluster_documents(spark, sf_dir):
    """The whole report: the leader with its server summary and change-log length, the others with lag and settings."""
    report_rows = health.member_report(
        _member_status(spark, sf_dir), _member_config(spark, sf_dir), keep=fleet.ORDER
    )
    lag = F.struct(F.floor("lag").cast("bigint").alias("value"), col("lag_text").alias("description"))
    report_rows = report_rows.withColumn("replLag", F.when(col("lag").isNotNull(), lag)).select(
        "cluster_id", *fleet.ORDER, "address", "stateStr", "errmsg", "replLag", "slaveDelay", "priority", "votes",
        "hidden", "tags",
    )
    leader = lookup.pick_first(
        fleet.members(spark, sf_dir), ["cluster"], fleet.ORDER, col("line") == 1, ["server", "part"]
    )
    spans = health.retention_span(fleet.events(spark, sf_dir), ["user_id"], F.floor(micros(col("ts")) / 1000000))
    servers = fleet.servers(spark, sf_dir)
    summary = F.struct(col("name").alias("host"), (col("balance") >= 0).alias("connection"))
    block = (
        leader.join(servers, "server", "left").join(spans, col("server") == col("user_id"), "left")
        .select(
            col("cluster").alias("cluster_id"), text(col("part")).alias("address"),
            F.lit("PRIMARY").alias("stateStr"), summary.alias("serverStatusSummary"),
            F.coalesce("span", F.lit("")).alias("oplogLength"),
        )
    )
    return health.status_documents(report_rows, block, ["cluster_id"], fleet.ORDER, fleet.split())


@query
def member_report(spark, sf_dir):
    return health.member_report(_member_status(spark, sf_dir), _member_config(spark, sf_dir)).withColumn(
        "tags", F.to_json("tags")
    )


# ---- listings and texts ------------------------------------------------------------------------

@query
def listing(spark, sf_dir):
    servers = fleet.servers(spark, sf_dir)
    return report.listing(
        servers, "server", {"description": F.when(col("balance") > 0, col("name")), "connect_to": col("address")}
    )


@query
def cluster_listing(spark, sf_dir):
    members = refs.resolve_refs(
        fleet.members(spark, sf_dir), "server", fleet.servers(spark, sf_dir).where(col("balance") >= 0), "server", col("address")
    )
    orders = fleet.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return report.member_listing(
        orders, "o_orderkey", members, "cluster", fleet.ORDER, fleet.split(), col("label"),
        hot=fleet.hot_clusters(spark, sf_dir),
    )


@query
def show(spark, sf_dir):
    docs = fleet.table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    return report.show(docs, "s_suppkey", 7, pretty=False)


@query
def redact(spark, sf_dir):
    rules = {"token": (r'(token = ")[0-9a-f]+(")', "$1****$2"), **tx.MASKING_RULES}
    docs = texts.redact(fleet.table(spark, sf_dir, "documents").select("doc_id", "text"), "text", rules)
    return docs.select("doc_id", F.md5("redacted").alias("digest"), "hits_token", "hits_uri", "hits_login")


@query
def redact_commands(spark, sf_dir):
    name = col("c_name")
    command = F.concat(
        F.lit("export -u "), name, F.lit(" -p "), F.md5(name), F.lit(" --sslPEMKeyPassword k"), col("c_custkey"),
        F.lit(" mongodb://"), name, F.when(col("c_acctbal") > 0, ":pw").otherwise(""), F.lit("@h:1/db"),
    )
    docs = fleet.table(spark, sf_dir, "customer").select("c_custkey", command.alias("command"))
    masked = texts.redact(docs, "command", name="masked")
    return texts.redact(masked, "command", tx.MASKING_RULES_KEEP_USER, "masked_keeping_user").select(
        "c_custkey", "masked", "masked_keeping_user"
    )


@query
def redaction_totals(spark, sf_dir):
    rules = {"token": (r'(token = ")[0-9a-f]+(")', "$1****$2"), "mail": (r"[\w.]+@[\w.]+", "****")}
    docs = texts.redact(fleet.table(spark, sf_dir, "documents").select("text"), "text", rules)
    return texts.redaction_totals(docs, list(rules))


@query
def parse_uris(spark, sf_dir):
    pages = texts.parse_uris(fleet.table(spark, sf_dir, "pages").select("page_id", "url"), "url", None)
    return pages.select("page_id", "scheme", col("nodes")[0]["host"].alias("host"), "database")


def _fleet_uris(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, segment = col("c_custkey"), col("c_mktsegment")
    uri = F.concat(
        F.lit("mongodb://"),
        F.when(segment == "BUILDING", F.concat(F.lit("u"), key, F.lit(":p%40w@"))).otherwise(""),
        F.lit("h"), key, F.lit(":"), key + 1000,
        F.when(segment == "MACHINERY", F.concat(F.lit(",h"), key + 1, F.lit(",h"), key + 2, F.lit(":5"))).otherwise(""),
        F.when(col("c_acctbal") > 0, F.concat(F.lit("/db"), col("c_nationkey"))).otherwise(""),
    )
    return fleet.table(spark, sf_dir, "customer").select("c_custkey", uri.alias("uri"))


@query
def parse_fleet_uris(spark, sf_dir):
    parsed = texts.parse_uris(_fleet_uris(spark, sf_dir), "uri")
    return parsed.select("c_custkey", "username", "password", "database", "is_cluster", "masked")


@query
def uri_nodes(spark, sf_dir):
    return texts.uri_nodes(texts.parse_uris(_fleet_uris(spark, sf_dir), "uri"), ["c_custkey"])


@query
def member_uris(spark, sf_dir):
    return texts.uris_per_member(_fleet_uris(spark, sf_dir), "uri", ["c_custkey"])


@query
def normalise_address(spark, sf_dir):
    servers = fleet.table(spark, sf_dir, "supplier").select(
        "s_suppkey",
        F.when(col("s_acctbal") > 6000, F.concat_ws(":", "s_name", "s_nationkey"))
        .when(col("s_acctbal") > 0, col("s_name")).alias("address"),
        F.when(col("s_nationkey") > 10, col("s_nationkey") + 27000).alias("port"),
    )
    return refs.normalise_address(servers, "address", col("port")).select(
        "s_suppkey", "full_address", "display_address"
    )


@query
def humanise_durations(spark, sf_dir):
    seconds = F.floor(col("value") * 1000)
    return fleet.table(spark, sf_dir, "events").select("event_id", humanise_seconds(seconds).alias("duration"))


@query
def small_columns(spark, sf_dir):
    output = F.concat(F.lit("db version v"), col("version"), F.lit(", pdfile\nmore 9.9.9"))
    forked = F.concat(F.lit("about to fork\nforked process: "), F.length("path"))
    return fleet.installs(spark, sf_dir).select(
        "path",
        tx.version_in(output).alias("version"),
        tx.forked_pid(forked).alias("forked"),
        tx.pid_of(F.concat(F.regexp_replace("path", "/opt/", ""), F.lit("\nx"))).alias("pid"),
        tx.pid_of(col("path")).alias("no_pid"),
        tx.ascii_only(F.concat(F.lit("é"), col("path"))).alias("plain"),
        F.size(tx.as_list(col("path"), False)).cast("bigint").alias("listed"),
    )


# ---- versions ----------------------------------------------------------------------------------

@query
def version_keys(spark, sf_dir):
    key = col("key")
    return fleet.installs(spark, sf_dir).withColumn("key", vs.version_key(col("version"))).select(
        "path", key["major"].alias("major"), key["minor"].alias("minor"), key["patch"].alias("patch"),
        (key["stage"] < 3).alias("is_pre"), vs.is_supported(col("version")).alias("supported"),
        vs.key_at_least(key, "2.6.1").alias("modern"), vs.is_valid(col("version"), col("edition")).alias("valid"),
    )


def _match(preference: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = ver.match_versions(fleet.version_requests(spark, sf_dir), fleet.installs(spark, sf_dir), preference)
        return out.select("server", "match_path", "match_version", "match_edition")

    run.__name__ = f"match_versions_{preference.lower()}"
    return query(run)


for _preference in (
    ver.EXACT, ver.MAJOR_GE, ver.LATEST_STABLE, ver.EXACT_OR_MINOR, ver.LATEST_MINOR, ver.DEFAULT
):
    _match(_preference)


@query
def classify_edition(spark, sf_dir):
    name = col("p_name")
    edition = ver.edition_from_output(
        F.regexp_replace(name, "red", "enterprise"), F.regexp_replace(name, "blue", "SSL")
    )
    build = ver.edition_from_build(
        F.regexp_replace(name, "small", "subscription"), F.when(name.contains("ring"), name),
        F.when(name.contains("bolt"), "disabled").when(name.contains("hot"), "on"),
    )
    return fleet.table(spark, sf_dir, "part").groupBy(edition.alias("by_output"), build.alias("by_build")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query
def version_inventory(spark, sf_dir):
    return ver.version_inventory(fleet.installs(spark, sf_dir), "version", "edition", "path")


PLATFORMS = [("linux", "64", "debian", "7.1"), ("osx", "64", None, None), ("linux", "32", "suse", "11")]


@query
def artifact_catalog(spark, sf_dir):
    wanted = fleet.installs(spark, sf_dir).select("path", "version")
    return ver.artifact_catalog(wanted, PLATFORMS).select("path", "os_name", "bits", "edition", "url", "archive")


@query
def storage_default(spark, sf_dir):
    engine = F.when(col("edition") == "enterprise", "wiredTiger").when(col("edition") == "community", "mmapv1")
    return ver.storage_default(fleet.installs(spark, sf_dir), "version", engine).select("path", "newer_engine")


# ---- activity and streams ----------------------------------------------------------------------

@query
def lifecycle_intervals(spark, sf_dir):
    out = act.lifecycle_intervals(fleet.activity(spark, sf_dir), "server", "ts", "seq", "op")
    return out.select("server", micros(col("started")).alias("started"), micros(col("stopped")).alias("stopped"), "pending")


def _awaited(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = fleet.events(spark, sf_dir)
    return (
        events.where(col("event_type") == "signup").select("user_id", "event_id", "ts"),
        events.where(col("event_type") == "purchase").select("user_id", "ts"),
    )


@query
def await_outcome(spark, sf_dir):
    requests, confirmations = _awaited(spark, sf_dir)
    out = act.await_outcome(requests, confirmations, ["user_id"], "ts", "ts", 20 * 3600, ["event_id"])
    return out.select("user_id", "event_id", micros(col("confirmed")).alias("confirmed"), "met")


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = fleet.table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return stream.withColumn("ts", col("ts").cast("timestamp"))


def _arrivals(df: DataFrame, id_col: str, late_seconds: int = LATE_SECONDS, pieces: int = 4) -> list[DataFrame]:
    """The table in the pieces it arrives in: every record comes up to ``late_seconds`` after its time, so pieces overlap."""
    arrival = micros(col("ts")) + F.pmod(F.xxhash64(id_col), F.lit(late_seconds)) * 1_000_000
    first, last = df.agg(F.min(arrival), F.max(arrival)).first()
    if first is None:
        return [df]
    step = (last - first) // pieces + 1
    return [df.where(F.floor((arrival - first) / step) == i) for i in range(pieces)]


@query
def follow_log(spark, sf_dir):
    """The log of each user is a file that grows: it is followed at a third, at two thirds and at its end, mostly within a line."""
    files, out, checkpoint = (scratch_path(spark, n) for n in ("logs", "records", "checkpoint"))
    for share in (0.34, 0.67, 1.0):
        write_logs(_log_lines(spark, sf_dir), files, share)
        feeds.follow_log(spark, files, out, checkpoint, pattern="*.log").awaitTermination()
    return feeds.read_records(spark, out).select(
        F.regexp_extract("file", r"([^/]+)\.log$", 1).alias("file"), "level",
        F.date_format("ts", logs.TIME_FORMAT).alias("ts"), "message", "continued",
    ).groupBy("file", "level", "ts", "message", "continued").agg(F.count(F.lit(1)).alias("n"))


@query
def follow_activity(spark, sf_dir):
    out = scratch_path(spark, "activity")
    records = activity_source.activity_records(_event_stream(spark, sf_dir), "event_type", "ts", "user_id")
    activity_source.stream_activity(records, out, scratch_path(spark, "checkpoint")).awaitTermination()
    return activity_source.read_activity(spark, out).groupBy("server", "op").agg(F.count(F.lit(1)).alias("n"))


@query
def follow_intervals(spark, sf_dir):
    """The activity arrives in four batches that overlap in time."""
    src, out, checkpoint = (scratch_path(spark, n) for n in ("days", "intervals", "checkpoint"))
    days = fleet.activity(spark, sf_dir)
    for piece in _arrivals(days, "seq"):
        piece.write.mode("append").parquet(src)
        stream = spark.readStream.schema(days.schema).parquet(src)
        feeds.follow_intervals(
            stream, "server", "ts", "seq", "op", out, checkpoint, delay_seconds=LATE_SECONDS
        ).awaitTermination()
    return feeds.read_intervals(spark, out).select(
        "server", micros(col("started")).alias("started"), micros(col("stopped")).alias("stopped"), "pending"
    )


@query
def status_feed(spark, sf_dir):
    """Four batches that overlap in time; two of them merge levels."""
    src, out, checkpoint = (scratch_path(spark, n) for n in ("snapshots", "status", "checkpoint"))
    rows = fleet.events(spark, sf_dir).select("user_id", "ts", "event_id", "event_type", "value")
    for piece in _arrivals(rows, "event_id"):
        piece.write.mode("append").parquet(src)
        stream = spark.readStream.schema(rows.schema).parquet(src)
        feeds.status_feed(stream, ["user_id"], ["ts", "event_id"], out, checkpoint, fan=2, buckets=4).awaitTermination()
    return feeds.read_latest(spark, out, ["user_id"], ["ts", "event_id"], rows.schema, fan=2, buckets=4).select(
        "user_id", "event_id", "event_type", "value"
    )


@query
def await_outcome_stream(spark, sf_dir):
    """Requests and confirmations arrive in four batches that overlap in time; no request is left out."""
    src, out, checkpoint = (scratch_path(spark, n) for n in ("requests", "outcomes", "checkpoint"))
    rows = fleet.events(spark, sf_dir).where(col("event_type").isin("signup", "purchase")).select(
        "user_id", "event_id", "ts", "event_type"
    )
    for piece in _arrivals(rows, "event_id"):
        piece.write.mode("append").parquet(src)
        feeds.follow_outcomes(
            spark.readStream.schema(rows.schema).parquet(src), ["user_id"], "ts", col("event_type") == "signup",
            col("event_type") == "purchase", 20 * 3600, out, checkpoint, keep=["event_id"], delay_seconds=LATE_SECONDS,
        ).awaitTermination()
    return feeds.read_outcomes(spark, out, ["user_id"], 20 * 3600, ["event_id"]).select(
        "user_id", "event_id", micros(col("confirmed")).alias("confirmed"), "met"
    )
