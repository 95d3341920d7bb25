"""Composite 0-100 score, min-max scaling and global min-rank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.numeric import clip, min_max_scale, safe_div, weighted_sum
from tallyframe.operators.ranking import min_rank_desc_bounded

# Component weights of the composite score (sum 1.0), in the
# order they are added.
DEFAULT_WEIGHTS = {
    "form": 0.25,
    "value": 0.15,
    "fixtures": 0.15,
    "xg_overperformance": 0.15,
    "ownership_momentum": 0.10,
    "ict": 0.10,
    "injury_risk": 0.10,
}

# Output column of each component's weighted contribution.
CONTRIBUTION_NAMES = {
    "form": "score_form",
    "value": "score_value",
    "fixtures": "score_fixtures",
    "xg_overperformance": "score_xg",
    "ownership_momentum": "score_momentum",
    "ict": "score_ict",
    "injury_risk": "score_injury",
}

_SCALED = ("form", "value", "xg_overperformance", "ownership_momentum", "ict")


def raw_components(players: DataFrame, fdr: DataFrame) -> DataFrame:
    """Unscaled component inputs plus the per-team difficulty (J3, left join)."""
    p = players.join(fdr, "team_id", "left")
    xg = F.coalesce(F.col("understat_xg"), F.col("expected_goals"))
    return p.select(
        "*",
        F.coalesce(F.col("form"), F.lit(0.0)).alias("_r_form"),
        F.coalesce(safe_div("total_points", F.col("now_cost") / F.lit(10)), F.lit(0.0)).alias("_r_value"),
        F.coalesce(F.col("goals_scored") - F.coalesce(xg, F.lit(0.0)), F.lit(0.0)).alias("_r_xg_overperformance"),
        F.coalesce(F.col("transfers_in") - F.col("transfers_out"), F.lit(0)).cast("double").alias("_r_ownership_momentum"),
        F.coalesce(F.col("ict_index"), F.lit(0.0)).alias("_r_ict"),
    )


def compute_scores(players: DataFrame, fdr: DataFrame, weights: dict | None = None) -> DataFrame:
    """Add ``composite_score``, ``composite_rank``, ``fdr_next_3/6`` and the seven
    rounded weighted contributions ``score_*``.

    Min/max of the five scaled components come from ONE aggregate (one row,
    broadcast back - its size is fixed), never a window over all rows.
    """
    w = dict(DEFAULT_WEIGHTS if weights is None else weights)
    r = raw_components(players, fdr)
    aggs = []
    for c in _SCALED:
        aggs += [F.min(f"_r_{c}").alias(f"_lo_{c}"), F.max(f"_r_{c}").alias(f"_hi_{c}")]
    stats = r.agg(*aggs)
    s = r.crossJoin(F.broadcast(stats))
    comps = {c: min_max_scale(f"_r_{c}", f"_lo_{c}", f"_hi_{c}") for c in _SCALED}
    comps["fixtures"] = clip((F.lit(5.0) - F.coalesce(F.col("fdr_next_3"), F.lit(3.0))) / F.lit(4.0) * F.lit(100.0), 0.0, 100.0)
    comps["injury_risk"] = clip(F.lit(100.0) - F.coalesce(F.col("injury_risk"), F.lit(2)).cast("double") * F.lit(10.0), 0.0, 100.0)
    s = s.select("*", *[comps[c].alias(f"_c_{c}") for c in DEFAULT_WEIGHTS])
    total = weighted_sum([(w[c], f"_c_{c}") for c in DEFAULT_WEIGHTS])
    keep = [F.col(f"`{x}`") for x in s.columns if not x.startswith(("_r_", "_lo_", "_hi_", "_c_"))]
    s = s.select(*keep, clip(F.bround(total, 1), 0.0, 100.0).alias("composite_score"),
                 *[F.bround(F.lit(float(w[c])) * F.col(f"_c_{c}"), 1).alias(name)
                   for c, name in CONTRIBUTION_NAMES.items()])
    return min_rank_desc_bounded(s, "composite_score", "composite_rank")
