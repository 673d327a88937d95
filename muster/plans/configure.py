"""The dry run of configuring every replica cluster at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.operators.reconcile import assign_ids, build_desired, configuration_rejects
from muster.operators.skew import hot_groups, join_per_key, none_hot
from muster.session import materialise


def configuration_plan(
    declared: DataFrame,
    current: DataFrame | None,
    cluster_id: str,
    pos: str,
    given_id: str,
    host: Column,
    server: Column,
    current_address: Column | None,
    split: Sequence[Column],
    keep: Sequence[str] = (),
    hosts: DataFrame | None = None,
    hot: DataFrame | None = None,
    errors: Column | None = None,
    header: DataFrame | None = None,
) -> DataFrame:
    """Desired members of every cluster with their ids, beside the columns of ``header`` (from ``desired_header``).

    Clusters that fail a check of ``configuration_rejects`` are left out; that operator says why.  The declared
    members are read by several steps, so they are written once; the sound ones are where several steps read them.
    """
    declared = materialise(declared, "declared")
    hot = hot if hot is not None else hot_groups(declared, [cluster_id])
    rejects = configuration_rejects(
        declared, current, cluster_id, pos, given_id, server, host, current_address, errors, hosts, hot
    ).select(cluster_id)
    # what the checks alone needed does not travel further
    kept = build_desired(declared, current, cluster_id, pos, host, [given_id, *keep])
    desired = join_per_key(kept, rejects, [cluster_id], "left_anti", hot)
    if hosts is not None or not none_hot(hot):  # else one step reads them
        desired = materialise(desired, "sound")
    plan = assign_ids(
        desired, current, cluster_id, pos, given_id, F.col("host"), current_address, split, hosts, hot=hot
    ).drop("turn", given_id)
    return plan if header is None else join_per_key(plan, header, [cluster_id], "left", hot)
