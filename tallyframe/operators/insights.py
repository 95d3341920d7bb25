"""Dashboard analytics as distributed operators: captain scores,
differentials, medians and quadrants, outliers, history views (momentum,
series, last-10, movers), score breakdown, radar, banding, head-to-head,
transfer verdicts and candidate lists, status/coverage roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.numeric import min_max_scale
from tallyframe.operators.ranking import position_within_key

# Captain score weights (form, xG/90, fixtures, points, ownership).
CAPTAIN_WEIGHTS = {"form": 0.3, "xg": 0.2, "fixture": 0.2, "points": 0.15, "ownership": 0.15}


# --- exact order statistics without a single-partition sort -------------------------

def order_stats(df: DataFrame, value: str, index_exprs: dict) -> DataFrame:
    """Exact order statistics of ``value`` (nulls dropped) as ONE row.

    ``index_exprs`` maps output name -> 0-based index expression of the
    count ``n``.  Positions come from a range-partitioned sort (no task
    holds more than one range), the count from one aggregate; the wanted
    positions are a handful of rows.
    """
    v = df.where(F.col(value).isNotNull()).select(F.col(value).alias("_v"))
    n = v.agg(F.count(F.lit(1)).alias("_n"))
    # Equal values may take any order, so a row number spreads a value that
    # very many rows hold over several ranges.
    pos = position_within_key(v.withColumn("_tie", F.monotonically_increasing_id()), [], ["_v", "_tie"], out="_pos")
    idx = n.select(*[e.alias(k) for k, e in index_exprs.items()], "_n")
    j = pos.join(F.broadcast(idx), F.lit(True))  # idx is one row
    aggs = [F.max(F.when(F.col("_pos") == F.col(k), F.col("_v"))).alias(k) for k in index_exprs]
    return j.agg(*aggs).crossJoin(n)


def order_stats_bounded(df: DataFrame, value: str, index_exprs: dict) -> DataFrame:
    """``order_stats`` for a value on a bounded grid (e.g. 1-dp scores in
    [0, 100]: at most 1001 distinct values): one partial aggregate to a
    histogram, a running count over the histogram rows (bounded by the
    grid, not the data), and the wanted positions read off it."""
    v = df.where(F.col(value).isNotNull())
    hist = v.groupBy(F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)  # <= grid size rows
    cum = hist.select("_v", "_c", F.sum("_c").over(w).alias("_cum"), F.sum("_c").over(Window.partitionBy()).alias("_n"))
    idx = [e.alias(k) for k, e in index_exprs.items()]
    c2 = cum.select("*", *idx)
    aggs = [F.max(F.when((F.col("_cum") - F.col("_c") <= F.col(k)) & (F.col(k) < F.col("_cum")), F.col("_v"))).alias(k)
            for k in index_exprs]
    n = v.agg(F.count(F.lit(1)).alias("_n"))
    return c2.agg(*aggs).crossJoin(n)


def exact_median(df: DataFrame, value: str, out: str, bounded: bool = False) -> DataFrame:
    """Mean of the two middle values (0 when empty)."""
    f = order_stats_bounded if bounded else order_stats
    s = f(df, value, {"_lo": F.floor((F.col("_n") - 1) / 2), "_hi": F.floor(F.col("_n") / 2)})
    return s.select(F.coalesce((F.col("_lo") + F.col("_hi")) / 2, F.lit(0.0)).alias(out))


def upper_median(df: DataFrame, value: str, out: str, default: float, bounded: bool = False) -> DataFrame:
    """``sorted[floor(n/2)]`` (not percentile_disc), default when empty."""
    f = order_stats_bounded if bounded else order_stats
    s = f(df, value, {"_m": F.floor(F.col("_n") / 2)})
    return s.select(F.coalesce(F.col("_m").cast("double"), F.lit(default)).alias(out))


# --- P27 A21 A31 A32 O7 ------------------------------------------------------------------

def captain_candidates(dash: DataFrame) -> DataFrame:
    """P27+A21: eligible players (minutes >= 270, outfield) and their
    unrounded captain score; min/max from one aggregate row."""
    e = dash.where((F.col("minutes") >= 270) & F.col("position").isin("MID", "FWD", "DEF"))
    xg90 = F.when(F.col("xg").isNotNull() & (F.col("minutes") > 0),
                  F.col("xg") / F.col("minutes") * 90).otherwise(F.lit(0.0))
    e = e.select("player_id", "web_name", "position", "ownership_pct", "fdr_next_3",
                 F.col("points_per_game").alias("_ppg"), xg90.alias("_xg90"),
                 F.col("total_points").cast("double").alias("_pts"))
    st = e.agg(F.min("_ppg").alias("_ppg_lo"), F.max("_ppg").alias("_ppg_hi"),
               F.min("_xg90").alias("_xg_lo"), F.max("_xg90").alias("_xg_hi"),
               F.min("_pts").alias("_pts_lo"), F.max("_pts").alias("_pts_hi"))
    s = e.crossJoin(F.broadcast(st))  # one-row statistics
    form = min_max_scale("_ppg", "_ppg_lo", "_ppg_hi")
    xg = min_max_scale("_xg90", "_xg_lo", "_xg_hi")
    fix = F.when(F.col("fdr_next_3").isNotNull(), (F.lit(5.0) - F.col("fdr_next_3")) / 4 * 100).otherwise(F.lit(50.0))
    pts = min_max_scale("_pts", "_pts_lo", "_pts_hi")
    own = F.least(F.col("ownership_pct"), F.lit(100.0))
    w = CAPTAIN_WEIGHTS
    score = form * w["form"] + xg * w["xg"] + fix * w["fixture"] + pts * w["points"] + own * w["ownership"]
    return s.select("player_id", "web_name", "position", "ownership_pct",
                    form.alias("form_norm"), xg.alias("xg90_norm"), fix.alias("fixture_norm"),
                    pts.alias("points_norm"), own.alias("ownership_norm"), score.alias("captain_score"))


def top_captains(cands: DataFrame, k: int = 15) -> DataFrame:
    """Top k by captain score (ties by id) with their rank."""
    t = cands.orderBy(F.col("captain_score").desc(), F.col("player_id").asc()).limit(k)
    w = Window.orderBy(F.col("captain_score").desc(), F.col("player_id").asc())  # <= k rows
    return t.select("*", F.row_number().over(w).alias("rank"))


def captain_differentials(cands: DataFrame) -> DataFrame:
    """The top 25 first, THEN ownership < 10 (order matters)."""
    return top_captains(cands, 25).where(F.col("ownership_pct") < 10)


def factor_shares(top: DataFrame) -> DataFrame:
    """A31+A32: each factor's weighted share of the total (20 each when the
    total is 0), long form, plus the factor's min/max over the shown rows."""
    w = CAPTAIN_WEIGHTS
    parts = [("form", "form_norm", w["form"]), ("xg", "xg90_norm", w["xg"]),
             ("fixture", "fixture_norm", w["fixture"]), ("points", "points_norm", w["points"]),
             ("ownership", "ownership_norm", w["ownership"])]
    weighted = [F.col(c) * wt for _, c, wt in parts]
    total = weighted[0]
    for x in weighted[1:]:
        total = total + x
    arr = F.array(*[F.struct(F.lit(name).alias("factor"), F.col(c).alias("value"), wx.alias("weighted"))
                    for (name, c, _), wx in zip(parts, weighted)])
    long = top.select("player_id", total.alias("_tot"), F.inline(arr))
    share = F.when(F.col("_tot") == 0, F.lit(20.0)).otherwise(F.col("weighted") / F.col("_tot") * 100)
    wf = Window.partitionBy("factor")  # at most k rows per factor
    return long.select("player_id", "factor", F.bround(share, 6).alias("share"),
                       F.bround(F.min("value").over(wf), 6).alias("factor_min"),
                       F.bround(F.max("value").over(wf), 6).alias("factor_max"))


# --- P28 O8 A16-A20 -------------------------------------------------------------------------

def differentials(dash: DataFrame, position: str | None = None, own_below: float = 15.0) -> DataFrame:
    """Low-ownership players and ``score * (1 - own/100)``."""
    d = dash.where(F.col("ownership_pct") < own_below)
    if position:
        d = d.where(F.col("position") == position)
    return d.select("player_id", "web_name", "position", "ownership_pct", "composite_score", "llm_summary",
                    (F.col("composite_score") * (1 - F.col("ownership_pct") / 100)).alias("differential_score"))


def quadrants(teams: DataFrame, med: DataFrame) -> DataFrame:
    """Team quadrant against the (one-row, broadcast) medians."""
    t = teams.where(F.col("avg_fdr_remaining").isNotNull()).crossJoin(F.broadcast(med))
    q = (F.when((F.col("avg_composite_score") >= F.col("med_score")) & (F.col("avg_fdr_remaining") <= F.col("med_fdr")),
                "strong_easy")
         .when((F.col("avg_composite_score") < F.col("med_score")) & (F.col("avg_fdr_remaining") > F.col("med_fdr")),
               "weak_hard")
         .otherwise("other"))
    return t.select("team_id", "team_name", "avg_composite_score", "avg_fdr_remaining", q.alias("quadrant"))


# --- history views --------------------------------------------------------------------------

def of_season(history: DataFrame, season: str | None) -> DataFrame:
    """The rows of one season; the latest one when none is named (a one-row
    aggregate is broadcast)."""
    if season is not None:
        return history.where(F.col("season") == season)
    latest = history.agg(F.max("season").alias("_season"))
    return history.join(F.broadcast(latest), F.col("season") == F.col("_season"), "left_semi")


def movers(history: DataFrame, first_gw, last_gw, k: int = 5, season: str | None = None) -> DataFrame:
    """J13+O9: first-vs-last gameweek delta within a season without a
    self-join (one aggregate with conditional ``max``), players missing either
    end dropped; the top-k risers and fallers by score, with the deltas of
    price and ownership where the history has them."""
    measures = {"composite_score": "delta", "price": "price_delta", "ownership_pct": "ownership_delta"}
    measures = {m: out for m, out in measures.items() if m in history.columns}
    ends = [F.max(F.when(F.col("gameweek") == gw, F.col(m))).alias(f"_{side}_{m}")
            for side, gw in (("f", first_gw), ("l", last_gw)) for m in measures]
    seen = [F.count_if(F.col("gameweek") == gw).alias(f"_{side}") for side, gw in (("f", first_gw), ("l", last_gw))]
    g = of_season(history, season).where(F.col("gameweek").isin(first_gw, last_gw)).groupBy("player_id") \
        .agg(*ends, *seen)
    d = g.where((F.col("_f") > 0) & (F.col("_l") > 0) & F.col("_f_composite_score").isNotNull()
                & F.col("_l_composite_score").isNotNull()) \
         .select("player_id", *[F.bround(F.col(f"_l_{m}") - F.col(f"_f_{m}"), 1).alias(out)
                                for m, out in measures.items()])
    up = d.orderBy(F.col("delta").desc(), F.col("player_id")).limit(k).select(F.lit("riser").alias("kind"), "*")
    dn = d.orderBy(F.col("delta").asc(), F.col("player_id")).limit(k).select(F.lit("faller").alias("kind"), "*")
    return up.unionByName(dn)


def last_n(history: DataFrame, n: int = 10) -> DataFrame:
    """Each player's last ``n`` scores in gameweek order (partial
    WindowGroupLimit, then a bounded ordered collect)."""
    w = Window.partitionBy("season", "player_id").orderBy(F.col("gameweek").desc())
    t = history.select("season", "player_id", "gameweek", "composite_score", F.row_number().over(w).alias("_r")) \
               .where(F.col("_r") <= n)
    g = t.groupBy("season", "player_id").agg(F.array_sort(F.collect_list(F.struct("gameweek", "composite_score"))).alias("_a"))
    return g.select("season", "player_id", F.col("_a").getField("composite_score").alias("last_scores"))


def score_series(history: DataFrame, players: DataFrame, gw_lo: int, gw_hi: int,
                 season: str | None = None) -> DataFrame:
    """Dense (player x gameweek) series of a season, missing -> 0.  The
    spine is an ``explode(sequence)`` per selected player, joined to the
    history."""
    spine = players.select("player_id", F.explode(F.sequence(F.lit(gw_lo), F.lit(gw_hi))).alias("gameweek"))
    h = of_season(history, season).select("player_id", "gameweek", "composite_score")
    return spine.join(h, ["player_id", "gameweek"], "left").select(
        "player_id", "gameweek", F.coalesce(F.col("composite_score"), F.lit(0.0)).alias("composite_score"))


def momentum_matrix(history: DataFrame, latest_gw: int, gws, top: int = 50, season: str | None = None) -> DataFrame:
    """Top players of a season by latest rank x gameweek scores, pivoted
    with an explicit value list (no extra job to discover the columns)."""
    history = of_season(history, season)
    topn = (history.where(F.col("gameweek") == latest_gw)
                   .orderBy(F.col("composite_rank").asc(), F.col("player_id").asc()).limit(top)
                   .select("player_id"))
    h = history.join(topn, "player_id", "left_semi")
    return h.groupBy("player_id").pivot("gameweek", list(gws)).agg(F.max("composite_score"))


# --- P30 P31 P32 ----------------------------------------------------------------------------

def banding(dash: DataFrame) -> DataFrame:
    """Display bands as CASE expressions (JS Math.round = floor(x+.5))."""
    s = F.col("composite_score")
    fdr_class = F.least(F.greatest(F.floor(F.coalesce(F.col("fdr_next_3"), F.lit(3.0)) + 0.5), F.lit(1)), F.lit(5))
    colour = F.when(s >= 65, "green").when(s >= 45, "neutral").otherwise("red")
    bar = (F.when(s >= 65, "green").when(s >= 50, "emerald").when(s >= 40, "amber")
            .when(s >= 30, "orange").otherwise("red"))
    rank = F.col("composite_rank")
    tier = F.when(rank <= 20, "Elite").when(rank <= 50, "High Value")
    sent = F.col("sentiment_score")
    sband = (F.when(sent.isNull(), "none").when(sent > 0.3, "strong_positive").when(sent > 0, "positive")
              .when(sent < -0.3, "strong_negative").when(sent < 0, "negative").otherwise("zero"))
    # Heat band of points-per-million against its min/max over the shown rows
    # (one aggregate row, broadcast).
    rng = dash.agg(F.min("points_per_million").alias("_lo"), F.max("points_per_million").alias("_hi"))
    d = dash.crossJoin(F.broadcast(rng))
    ratio = (F.col("points_per_million") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    heat = F.when(F.col("_hi") == F.col("_lo"), "").when(ratio > 0.7, "high").when(ratio < 0.3, "low").otherwise("")
    return d.select("player_id", fdr_class.cast("int").alias("fdr_class"), colour.alias("score_colour"),
                    bar.alias("score_bar"), tier.alias("tier"), sband.alias("sentiment_band"),
                    heat.alias("ppm_heat"))


def radar(dash: DataFrame) -> DataFrame:
    """Six stats over per-stat scales (goals max(g,20), assists
    max(a,15), xG 20 with goals x 0.8 fallback, creativity/10, threat/10,
    ICT/3 over 100), capped at 100; long form."""
    g, a = F.col("goals_scored").cast("double"), F.col("assists").cast("double")
    stats = [("Goals", g, F.greatest(g, F.lit(20.0))), ("Assists", a, F.greatest(a, F.lit(15.0))),
             ("xG", F.coalesce(F.col("xg"), g * 0.8), F.lit(20.0)),
             ("Creativity", F.col("creativity") / 10, F.lit(100.0)), ("Threat", F.col("threat") / 10, F.lit(100.0)),
             ("ICT", F.col("ict_index") / 3, F.lit(100.0))]
    arr = F.array(*[F.struct(F.lit(n).alias("stat"),
                             F.bround(F.least(v / m * 100, F.lit(100.0)), 6).alias("value")) for n, v, m in stats])
    return dash.select("player_id", F.inline(arr))


COMPONENTS = ["score_form", "score_value", "score_fixtures", "score_xg", "score_momentum", "score_ict", "score_injury"]


def score_breakdown(dash: DataFrame) -> DataFrame:
    """Positive components in long form (null -> 0 dropped)."""
    u = dash.select("player_id", *COMPONENTS).unpivot("player_id", COMPONENTS, "component", "value")
    u = u.select("player_id", "component", F.coalesce(F.col("value"), F.lit(0.0)).alias("value"))
    return u.where(F.col("value") > 0)


def score_pyramid(pairs: DataFrame, dash: DataFrame) -> DataFrame:
    """P32 for a swap: all seven components of both players, the sell side
    mirrored below zero; a missing component is 0.  ``pairs``: sell_id, buy_id."""
    side = lambda s: dash.select(F.col("player_id").alias(f"{s}_id"), *[
        F.coalesce(F.col(c), F.lit(0.0)).alias(f"_{s}_{c}") for c in COMPONENTS])
    j = pairs.select("sell_id", "buy_id").join(side("sell"), "sell_id").join(side("buy"), "buy_id")
    parts = F.array(*[F.struct(F.lit(c).alias("component"), (0.0 - F.col(f"_sell_{c}")).alias("sell"),
                               F.col(f"_buy_{c}").alias("buy")) for c in COMPONENTS])
    return j.select("sell_id", "buy_id", F.inline(parts))


# --- J12 J16 J17 P29 ------------------------------------------------------------------------

H2H_METRICS = [("composite_score", True), ("form", True), ("total_points", True), ("price", False),
               ("points_per_million", True), ("ownership_pct", True), ("fdr_next_3", False),
               ("injury_risk", False), ("xg", True), ("ict_index", True), ("net_transfers", True),
               ("minutes", True)]


def head_to_head(pairs: DataFrame, dash: DataFrame) -> DataFrame:
    """Pairs (pair_id, a_id, b_id) joined twice to the players,
    metrics unpivoted with a direction-aware ``better`` flag."""
    cols = [m for m, _ in H2H_METRICS]
    a = dash.select(F.col("player_id").alias("a_id"), *[F.col(c).cast("double").alias(f"a_{c}") for c in cols])
    b = dash.select(F.col("player_id").alias("b_id"), *[F.col(c).cast("double").alias(f"b_{c}") for c in cols])
    j = pairs.join(a, "a_id", "inner").join(b, "b_id", "inner")
    items = []
    for m, hib in H2H_METRICS:
        av, bv = F.col(f"a_{m}"), F.col(f"b_{m}")
        better = (F.when(av.isNull() | bv.isNull() | (av == bv), F.lit("tie"))
                  .when((av > bv) if hib else (av < bv), F.lit("a")).otherwise(F.lit("b")))
        items.append(F.struct(F.lit(m).alias("metric"), av.alias("a_value"), bv.alias("b_value"),
                              better.alias("better")))
    return j.select("pair_id", "a_id", "b_id", F.inline(F.array(*items)))


# The transfer verdict texts.
VERDICT_UPGRADE = "Strong upgrade. %s scores %.1f points higher than %s on the FPL Score index."
VERDICT_LATERAL = ("Lateral move. The FPL Score difference is only %.1f points — "
                   "consider the fixture run before committing.")
VERDICT_DOWNGRADE = ("Downgrade. %s scores %.1f points lower — only worthwhile if you are freeing budget for a "
                     "bigger upgrade elsewhere.")
VERDICT_EASIER = "Better fixtures ahead: %s has an easier next-3 FDR (%.1f vs %.1f)."
VERDICT_TOUGHER = "Tougher fixtures ahead: %s faces harder games in the next 3 (%.1f vs %.1f)."
VERDICT_BUDGET = "Frees up £%.1fm in budget."


def verdict(sell: str = "s_", buy: str = "b_") -> F.Column:
    """Text verdict for a (sell, buy) pair (rules fixed by the product):
    +-5 score bands, +-0.5 difficulty, price gap > 0.5 frees budget."""
    buyer, seller = F.col(f"{buy}web_name"), F.col(f"{sell}web_name")
    diff = F.col(f"{buy}composite_score") - F.col(f"{sell}composite_score")
    head = (F.when(diff > 5, F.format_string(VERDICT_UPGRADE, buyer, diff, seller))
             .when(diff >= -5, F.format_string(VERDICT_LATERAL, F.abs(diff)))
             .otherwise(F.format_string(VERDICT_DOWNGRADE, buyer, F.abs(diff))))
    fs = F.coalesce(F.col(f"{sell}fdr_next_3"), F.lit(3.0))
    fb = F.coalesce(F.col(f"{buy}fdr_next_3"), F.lit(3.0))
    fdr_d = fs - fb
    fix = (F.when(fdr_d > 0.5, F.format_string(VERDICT_EASIER, buyer, fb, fs))
            .when(fdr_d < -0.5, F.format_string(VERDICT_TOUGHER, buyer, fb, fs)))
    pdelta = F.col(f"{sell}price") - F.col(f"{buy}price")
    price = F.when(pdelta > 0.5, F.format_string(VERDICT_BUDGET, pdelta))
    return F.concat_ws(" ", head, fix, price)


def buy_candidates(sells: DataFrame, dash: DataFrame, k: int = 50) -> DataFrame:
    """Per sell candidate, same-position players (not itself), top k by
    score.

    Joining sells to ALL players of their position would put every player
    of a position behind one of four join keys (skew) and emit
    sells x players pairs.  The top k of a position differ between sells
    only by the sell itself, so the position's top k+1 are computed once
    (partial WindowGroupLimit: at most k+1 rows per position per map task),
    giving a list of at most 4 x (k+1) rows -- a proven bound, broadcast --
    and each sell keeps the first k that are not itself."""
    cols = ("web_name", "composite_score", "fdr_next_3", "price")
    s = sells.select(F.col("player_id").alias("sell_id"), F.col("position").alias("_pos"),
                     *[F.col(c).alias(f"s_{c}") for c in cols])
    wp = Window.partitionBy("position").orderBy(F.col("composite_score").desc(), F.col("player_id").asc())
    top = dash.where(F.col("position").isNotNull()).select("*", F.row_number().over(wp).alias("_pr")) \
              .where(F.col("_pr") <= k + 1)
    b = top.select(F.col("player_id").alias("buy_id"), F.col("position").alias("_pos"),
                   *[F.col(c).alias(f"b_{c}") for c in cols])
    j = s.join(F.broadcast(b), "_pos", "inner").where(F.col("sell_id") != F.col("buy_id"))
    w = Window.partitionBy("sell_id").orderBy(F.col("b_composite_score").desc(), F.col("buy_id").asc())
    r = j.select("*", F.row_number().over(w).alias("rank")).where(F.col("rank") <= k)
    return r.select("sell_id", "rank", "buy_id", verdict().alias("verdict"),
                    F.bround(F.col("s_price") - F.col("b_price"), 1).alias("price_delta"))


def transfer_hub(picks: DataFrame, sort_key: str, k: int = 30, recommendation: str | None = None,
                 position: str | None = None) -> DataFrame:
    """P29+O8: picks of a recommendation and a position (None: all), sorted by
    a chosen key with null FDR treated as 3 and other nulls as 0; the first k
    rows."""
    for column, wanted in (("recommendation", recommendation), ("position", position)):
        if wanted is not None:
            picks = picks.where(F.col(column) == wanted)
    key = F.coalesce(F.col(sort_key), F.lit(3.0 if sort_key.startswith("fdr") else 0.0))
    asc = sort_key.startswith("fdr") or sort_key == "price"
    o = key.asc() if asc else key.desc()
    t = picks.orderBy(o, F.col("player_id").asc()).limit(k)
    w = Window.orderBy(o, F.col("player_id").asc())  # <= k rows
    return t.select(F.row_number().over(w).alias("rank"), "player_id", "recommendation",
                    key.alias("sort_value"))
