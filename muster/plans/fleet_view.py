"""The test tables read as a fleet.

cluster = order, member = line item, server = supplier, sharded cluster → shard → server = region → nation →
supplier, change log and activity = events.  Every function projects; none reads more than its columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.operators.ordered import with_position
from muster.operators.skew import HOT_ROWS, dealt, hot_groups

# total order of the members of a cluster
ORDER = ["line", "part", "server", "price", "quantity", "optime"]


# declared, so that opening a table starts no job to look at its files
TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
    " o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,"
    " l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string,"
    " l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "pages": "page_id bigint, url string, html string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def split() -> list[Column]:
    """Monotone pieces of that order, used only inside very large clusters."""
    return [F.col("line"), F.floor(F.col("part") / 1000).cast("bigint")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("cluster"),
        F.col("l_linenumber").cast("bigint").alias("line"),
        F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("server"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_shipdate").alias("optime"),
        (F.col("l_returnflag") == "N").alias("arbiter"),
        (F.col("l_returnflag") == "R").alias("config"),
        (F.col("l_discount") <= 0.02).alias("passive"),
        F.when(F.col("l_linestatus") == "F", "PRIMARY").otherwise("SECONDARY").alias("state"),
    )


def hot_clusters(spark: SparkSession, sf_dir: str, rows: int = HOT_ROWS) -> DataFrame:
    """Very large clusters, counted on the key column alone."""
    return hot_groups(members(spark, sf_dir), ["cluster"], rows)


def placed_members(spark: SparkSession, sf_dir: str, hot: DataFrame | None = None) -> DataFrame:
    """Members with their zero-based array position ``pos``; ``hot`` from ``hot_clusters``, where that is at hand."""
    hot = hot if hot is not None else hot_clusters(spark, sf_dir)
    return with_position(dealt(members(spark, sf_dir), ["cluster"], hot), ["cluster"], ORDER, split(), hot=hot)


def servers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("server"),
        F.col("s_name").alias("name"),
        F.col("s_nationkey").alias("nation"),
        F.col("s_acctbal").alias("balance"),
        F.concat(F.col("s_name"), F.lit(":"), F.col("s_suppkey") + 27000).alias("address"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts and stops: sign-ups and errors of a user."""
    op = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "error", "stop")
    return events(spark, sf_dir).select(
        F.col("user_id").alias("server"), "ts", F.col("event_id").alias("seq"), op.alias("op")
    ).where(F.col("op").isNotNull())


def installs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Installed versions, made up from the parts."""
    size, kind = F.col("p_size"), F.col("p_type")
    release = F.concat_ws(
        ".", F.floor(size / 17) + 1, size % 7, F.regexp_extract("p_brand", r"#(\d+)", 1)
    )
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("/opt/"), F.col("p_partkey")).alias("path"),
        F.when(kind == "PROMO", F.concat(release, F.lit("-rc"), size % 3)).otherwise(release).alias("version"),
        F.when(kind == "ECONOMY", "enterprise")
        .when(kind == "MEDIUM", "community_ssl")
        .when(kind == "STANDARD", "community")
        .alias("edition"),
    )


def version_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions asked for, made up from the suppliers; a negative balance asks for none in particular."""
    nation = F.col("s_nationkey")
    version = F.concat_ws(
        ".", F.floor(nation / 9) + 1, nation % 7, F.floor(F.col("s_acctbal") / 400) + 1
    )
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("server"),
        F.when(F.col("s_acctbal") >= 0, version).alias("version"),
        F.when(nation < 8, "enterprise").when(nation < 16, "community_ssl").alias("edition"),
    )


def topology_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region → nation → supplier as cluster references."""
    shards = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("region-"), F.col("n_regionkey")).alias("cluster_id"),
        F.lit("shards").alias("role"),
        F.col("n_nationkey").cast("bigint").alias("pos"),
        F.lit("cluster").alias("child_kind"),
        F.concat(F.lit("nation-"), F.col("n_nationkey")).alias("child_id"),
    )
    inner = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("nation-"), F.col("s_nationkey")).alias("cluster_id"),
        F.lit("members").alias("role"),
        F.col("s_suppkey").alias("pos"),
        F.lit("server").alias("child_kind"),
        F.col("s_suppkey").cast("string").alias("child_id"),
    )
    return shards.unionByName(inner).withColumn("source", F.lit("file"))


def cluster_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One cluster document per customer, in the document form: lists of references, mixed configServers."""

    def ref(kind: str, key: Column) -> Column:
        return F.struct(F.lit(kind).alias("$ref"), key.cast("string").alias("$id"))

    no_ref = F.lit(None).cast("struct<`$ref`:string,`$id`:string>")
    key, nation, segment = F.col("c_custkey"), F.col("c_nationkey"), F.col("c_mktsegment")
    member = F.struct(ref("servers", key).alias("server"), no_ref.alias("cluster"), F.lit(None).cast("string").alias("host"))
    shard_server = F.struct(ref("servers", nation).alias("server"), no_ref.alias("cluster"))
    shard_cluster = F.struct(no_ref.alias("server"), ref("clusters", nation).alias("cluster"))

    def listed(n: int) -> Column:
        items = [F.struct(ref("servers", key + i).alias("server")) for i in range(n)]
        return F.to_json(F.array(*items))

    config = (
        F.when(segment == "BUILDING", F.to_json(ref("clusters", key)))
        .when(segment == "MACHINERY", listed(1))
        .when(segment == "HOUSEHOLD", listed(2))
        .when(segment == "FURNITURE", listed(3))
    )
    return table(spark, sf_dir, "customer").select(
        key.cast("string").alias("_id"),
        F.when(F.col("c_acctbal") >= 0, "ShardedCluster").alias("_type"),
        F.array(member).alias("members"),
        F.array(shard_server, shard_cluster).alias("shards"),
        config.alias("configServers"),
    )
