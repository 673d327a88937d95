"""Status, lag, ranking and retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from muster.functions.durations import humanise_seconds, micros, seconds_between
from muster.functions.text import first_rule
from muster.operators.lookup import pick_first
from muster.operators.ordered import PART_ROWS, ordered_concat
from muster.operators.skew import join_per_key

# fixed values: states whose lag is reported, and the texts looked for in errors, in order
LAG_STATES = ["STARTUP2", "SECONDARY", "RECOVERING"]
START_RULES = [
    ("timed_out", ["timed out"]),
    ("port_in_use", ["closed", "reset", "ids don't match"]),
    ("ssl_mismatch", ["SSL handshake failed"]),
]
STOP_RULES = [
    ("timed_out", ["timed out"]),
    ("ssl_mismatch", ["SSL handshake failed"]),
    ("too_many_connections", ["connection closed"]),
]
ONLINE_RULES = [("offline", ["refused"])]


def latest_snapshot(
    snapshots: DataFrame, key: Sequence[str], order: Sequence[str], columns: Sequence[str] | None = None
) -> DataFrame:
    """The newest row per key, reduced before the shuffle."""
    kept = columns or [c for c in snapshots.columns if c not in key]
    newest = F.max_by(F.struct(*kept), F.struct(*order)).alias("_last")
    return snapshots.groupBy(*key).agg(newest).select(*key, "_last.*")


def status_summary(snapshots: DataFrame) -> DataFrame:
    """Latest host, version and connections per server, without the total ever created."""
    latest = latest_snapshot(
        snapshots, ["server"], ["ts", "seq"], ["ts", "connection", "error", "host", "version", "connections"]
    )
    return latest.withColumns(
        {
            "connections": F.col("connections").dropFields("totalCreated"),
            "timedOut": F.when(F.lower("error").contains("timed out"), True),
        }
    )


def classify_outcome(
    df: DataFrame, error: str, rules: list[tuple[str, list[str]]], default: str = "other", name: str = "outcome"
) -> DataFrame:
    """Name of the first rule that applies to the error text; null where there is no error."""
    return df.withColumn(name, F.when(F.col(error).isNotNull(), first_rule(F.col(error), rules, default)))


def lag_seconds(optime: Column, leader_optime: Column) -> Column:
    """Absolute: a member ahead of its leader shows a positive lag too."""
    return F.abs(seconds_between(optime, leader_optime))


def lag_to_leader(
    members: DataFrame,
    leaders: DataFrame,
    group: Sequence[str],
    optime: str,
    leader_optime: str,
    where: Column,
    name: str = "lag",
    hot: DataFrame | None = None,
) -> DataFrame:
    """Lag of the members that meet ``where``.

    Members of a cluster without a leader stay, with ``missing_leader`` set and neither leader nor lag.
    """
    led = leaders.withColumn("_led", F.lit(True))
    return (
        join_per_key(members.where(where), led, group, "left", hot=hot)
        .withColumn(name, lag_seconds(F.col(optime), F.col(leader_optime)))
        .withColumn("missing_leader", F.col("_led").isNull())
        .drop("_led")
    )


def rank_candidates(
    lagging: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    passive: Column,
    lag: str = "lag",
    max_lag: float | None = None,
    k: int = 1,
    values: Sequence[str] | None = None,
) -> DataFrame:
    """The ``k`` best secondaries per cluster: passive ones first, then the least lag, then array order.

    A lag equal to ``max_lag`` still counts; 0 and None mean no limit.  Where ``lagging`` says so in
    ``missing_leader``, there is nothing to rank: such a cluster gives one row with the flag and nothing else.
    """
    flagged = "missing_leader" in lagging.columns
    lost = F.col("missing_leader") if flagged else F.lit(False)
    kept = lagging.where(lost | (F.col(lag) <= max_lag)) if max_lag else lagging
    turn = F.when(F.coalesce(passive, F.lit(False)), 0).otherwise(1)
    values = list(values or [c for c in lagging.columns if c not in group])
    if k == 1:
        best = pick_first(
            kept.withColumn("_turn", turn), group, ["_turn", lag, *order], F.lit(True), values
        )
    else:
        place = Window.partitionBy(*group).orderBy(turn, F.col(lag), *[F.col(c) for c in order])
        ranked = kept.withColumn("_place", F.row_number().over(place)).where(F.col("_place") <= k)
        best = ranked.where(~lost | (F.col("_place") == 1)).select(*group, *values)
    if not flagged:
        return best
    return best.select(
        *group, *[c if c == "missing_leader" else F.when(~lost, F.col(c)).alias(c) for c in values]
    )


def retention_span(log: DataFrame, group: Sequence[str], seconds: Column, keys: DataFrame | None = None) -> DataFrame:
    """First and last change per group: whole seconds, whole hours and the text.

    With ``keys`` (all groups), those without any change get the empty text.
    """
    spans = (
        log.groupBy(*group)
        .agg(F.min(seconds).alias("_first"), F.max(seconds).alias("_last"))
        .withColumn("seconds", (F.col("_last") - F.col("_first")).cast("bigint"))
        .withColumn("hours", F.floor(F.col("seconds") / 3600).cast("bigint"))
        .select(*group, "seconds", "hours", F.format_string("%d secs (%d hours)", "seconds", "hours").alias("span"))
    )
    if keys is None:
        return spans
    return keys.join(spans, list(group), "left").withColumn("span", F.coalesce("span", F.lit("")))


def enrich_status(
    status: DataFrame, config: DataFrame, status_key: Sequence[str], config_key: Sequence[str]
) -> DataFrame:
    """Status members with the settings of their config member, non-default values only."""
    settings = {
        "slaveDelay": F.col("_cfg.slaveDelay"),
        "priority": F.nullif(F.col("_cfg.priority"), F.lit(1)),
        "votes": F.nullif(F.col("_cfg.votes"), F.lit(1)),
        "hidden": F.nullif(F.col("_cfg.hidden"), F.lit(False)),
        "tags": F.when(F.size("_cfg.tags") > 0, F.col("_cfg.tags")),
    }
    present = {k: v for k, v in settings.items() if k in config.columns}
    packed = config.select(
        *[F.col(c).alias(f"_k{i}") for i, c in enumerate(config_key)], F.struct(*present).alias("_cfg")
    )
    on = [status[a] == packed[f"_k{i}"] for i, a in enumerate(status_key)]
    joined = status.join(packed, on, "left")
    return joined.select(*[status[c] for c in status.columns], *[v.alias(k) for k, v in present.items()])


def member_report(
    status: DataFrame,
    config: DataFrame | None = None,
    cluster_id: str = "cluster_id",
    hot: DataFrame | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per member other than the leader: address, state, lag in three states, and its settings.

    Expects ``MEMBER_STATUS`` columns; the leader of a cluster is the row that reports on itself.  Members of a
    cluster without one have ``missing_leader`` set and no lag.  ``keep`` names further columns of ``status``.
    """
    leaders = status.where("is_self").groupBy(cluster_id).agg(F.max("optimeDate").alias("_leader_optime"))
    others = join_per_key(
        status.where(~F.coalesce(F.col("is_self"), F.lit(False))), leaders.withColumn("_led", F.lit(True)),
        [cluster_id], "left", hot=hot,
    )
    lag = F.when(F.col("stateStr").isin(LAG_STATES), lag_seconds(F.col("optimeDate"), F.col("_leader_optime")))
    report = others.select(
        cluster_id,
        F.col("name").alias("address"),
        "stateStr",
        F.nullif("errmsg", F.lit("")).alias("errmsg"),
        lag.alias("lag"),
        humanise_seconds(lag).alias("lag_text"),
        F.col("_led").isNull().alias("missing_leader"),
        *keep,
    )
    if config is None:
        return report
    return enrich_status(report, config, [cluster_id, "address"], [cluster_id, "host"])


def cluster_status(
    members: DataFrame,
    leaders: DataFrame,
    group: Sequence[str],
    optime: str,
    leader_optime: str,
    is_leader: Column,
    spans: DataFrame | None = None,
    hot: DataFrame | None = None,
) -> DataFrame:
    """One flat row per cluster: its leader, how many others, their newest optime, how many are behind.

    The members of a cluster are aggregated, never gathered, so a cluster of any size is one row.  A cluster
    without a leader has ``missing_leader`` set, and all its members are others.
    ``is_leader`` compares a member with the joined leader columns.
    """
    ahead = micros(F.col(leader_optime))
    own = micros(F.col(optime))
    lag = lag_seconds(F.col(optime), F.col(leader_optime))
    led = leaders.withColumn("_led", F.lit(True))
    joined = join_per_key(members, led, group, "left", hot=hot).withColumn("_leader", F.coalesce(is_leader, F.lit(False)))
    other = ~F.col("_leader")
    carried = [c for c in leaders.columns if c not in group]
    out = joined.groupBy(*group).agg(
        *[F.first(c).alias(c) for c in carried],
        F.count_if(other).alias("others"),
        F.max(F.when(other, F.col(optime))).alias("newest_other"),
        F.count_if(other & (own < ahead)).alias("behind"),
        F.max(F.when(other, lag)).alias("largest_lag"),
        F.first("_led").isNull().alias("missing_leader"),
    )
    return out.join(spans, list(group), "left") if spans is not None else out


def status_documents(
    report: DataFrame,
    leaders: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    split: Sequence[Column],
    part_rows: int = PART_ROWS,
    hot: DataFrame | None = None,
) -> DataFrame:
    """JSON status per cluster: the leader block and the other members in order.

    Every ``part_rows`` members are a part; the parts of a cluster joined by a comma are the whole document.  The
    leader block of a cluster without a leader is null, and ``missing_leader`` is set.
    """
    fields = [c for c in report.columns if c not in (*group, *order, "missing_leader")]
    listed = ordered_concat(
        report, group, order, split, F.to_json(F.struct(*fields)), "members", part_rows=part_rows, hot=hot
    )
    block = leaders.select(
        *group, F.to_json(F.struct(*[c for c in leaders.columns if c not in group])).alias("primary")
    )
    head = F.concat(F.lit('{"primary":'), F.coalesce("primary", F.lit("null")), F.lit(',"otherMembers":['))
    return listed.join(block, list(group), "left").select(
        *group,
        "part",
        "parts",
        F.concat(
            F.when(F.col("part") == 0, head).otherwise(""),
            F.col("members"),
            F.when(F.col("part") == F.col("parts") - 1, "]}").otherwise(""),
        ).alias("status"),
        F.col("primary").isNull().alias("missing_leader"),
    )
