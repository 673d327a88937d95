"""Which member of each cluster should be exported from?"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.operators.health import lag_to_leader, rank_candidates
from muster.operators.lookup import pick_first
from muster.operators.skew import hot_groups


def export_sources(
    members: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    server: str,
    optime: str,
    is_leader: Column,
    is_secondary: Column,
    passive: str,
    max_lag: float | None = None,
    k: int = 1,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Leader → lag → best candidate, for all clusters at once; a cluster without a leader is flagged.

    Leaders and candidates are reduced before their shuffles (one row per cluster and map task); only the
    secondaries are shuffled as they are, for the join with the leaders, and not those of hot clusters.
    """
    leaders = pick_first(
        members, group, order, is_leader,
        [F.col(server).alias("leader"), F.col(optime).alias("leader_optime")],
    )
    hot = hot if hot is not None else hot_groups(members, group)
    lagging = lag_to_leader(members, leaders, group, optime, "leader_optime", is_secondary, hot=hot)
    return rank_candidates(
        lagging, group, order, F.col(passive), max_lag=max_lag, k=k,
        values=["leader", server, passive, "lag", "missing_leader"],
    )
