"""Curated tables: dashboard, transfer picks, team strength, briefing, history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.numeric import safe_div
from tallyframe.operators.fixtures import with_team_names
from tallyframe.operators.scoring import compute_scores

# element_type code -> position label.
POSITION_MAP = {1: "GKP", 2: "DEF", 3: "MID", 4: "FWD"}
TOTAL_GAMEWEEKS = 38


def position_label(c) -> F.Column:
    """P5: code 1-4 -> GKP/DEF/MID/FWD, anything else -> null."""
    e = F.col(c) if isinstance(c, str) else c
    out = None
    for code, label in POSITION_MAP.items():
        out = F.when(e == code, F.lit(label)) if out is None else out.when(e == code, F.lit(label))
    return out


def advice_gameweek(gameweek: int, total: int = TOTAL_GAMEWEEKS):
    return gameweek + 1 if gameweek < total else None


def enriched_only(players: DataFrame) -> DataFrame:
    """Rows carrying an enrichment summary.  This is semantics, not an
    optimisation: it must precede scoring because it changes min/max."""
    return players.where(F.col("summary").isNotNull())


def player_dashboard(players: DataFrame, teams: DataFrame, fdr: DataFrame, season: str,
                     gameweek: int, advice_gw, weights: dict | None = None) -> DataFrame:
    """Score the enriched players and project the dashboard contract."""
    scored = compute_scores(enriched_only(players), fdr, weights)
    scored = with_team_names(scored, teams, "team_id", "team_")
    price = F.col("now_cost") / F.lit(10)
    xg = F.coalesce(F.col("understat_xg"), F.col("expected_goals"))
    return scored.select(
        "player_id", "web_name",
        F.concat(F.col("first_name"), F.lit(" "), F.col("second_name")).alias("full_name"),
        "team_id", "team_name", "team_short",
        position_label("element_type").alias("position"),
        "total_points", "minutes", "goals_scored", "assists", "clean_sheets", "bonus",
        "form", "points_per_game",
        F.bround(price, 1).alias("price"),
        F.col("selected_by_percent").alias("ownership_pct"),
        F.coalesce(F.bround(safe_div("total_points", price), 1), F.lit(0.0)).alias("points_per_million"),
        "transfers_in", "transfers_out",
        (F.col("transfers_in") - F.col("transfers_out")).alias("net_transfers"),
        F.col("understat_xg").alias("xg"), F.col("understat_xa").alias("xa"),
        F.col("understat_npxg").alias("npxg"),
        F.when(xg.isNull(), F.lit(None)).otherwise(F.col("goals_scored") - xg).alias("xg_delta"),
        "influence", "creativity", "threat", "ict_index",
        "form_trend", "form_confidence", F.col("summary").alias("llm_summary"),
        "injury_risk", "injury_reasoning", "sentiment_label", "sentiment_score", "key_themes",
        "fdr_next_3", "fdr_next_6", "best_gameweeks", "fixture_recommendation",
        "composite_score", "composite_rank",
        "score_form", "score_value", "score_fixtures", "score_xg", "score_momentum",
        "score_ict", "score_injury",
        F.lit(season).alias("season"), F.lit(gameweek).cast("int").alias("gameweek"),
        F.lit(advice_gw).cast("int").alias("advice_gameweek"),
        "src_pos",
    )


def _reasons(*pairs):
    """Ordered list of the reasons whose condition holds (nulls dropped)."""
    return F.filter(F.array(*[F.when(cond, txt) for cond, txt in pairs]), lambda x: x.isNotNull())


# The recommendation reason texts (sell rules, buy rules, extras).
REASON_INJURY = "High injury risk (%d/10)"
REASON_POOR_FORM = "Poor form (%.1f)"
REASON_DECLINING = "Declining form trend"
REASON_HARD_FIXTURES = "Very hard fixtures (FDR %.1f)"
REASON_LOW_SCORE = "Low FPL score (%.1f)"
REASON_STRONG_SCORE = "Strong FPL score (%.1f)"
REASON_GOOD_FORM = "Good form (%.1f)"
REASON_IMPROVING = "Improving form trend"
REASON_EASY_FIXTURES = "Favorable fixtures (FDR %.1f)"
REASON_FIT = "Minimal injury risk"
REASON_VALUE = "Great value (%.1f pts/£m)"
REASON_DEMAND = "High transfer demand (+%s)"
REASON_NO_SIGNAL = "FPL score %.1f — no strong signals"


def classify(dash: DataFrame) -> DataFrame:
    """buy/sell/hold/watch + ordered reasons (rules fixed by the product).

    Signals are sums of ``when`` flags; the reason lists are filtered arrays,
    so the whole classifier is one projection inside whole-stage codegen.
    """
    score, form = F.col("composite_score"), F.col("form")
    fdr, inj = F.col("fdr_next_3"), F.col("injury_risk")
    net, trend = F.col("net_transfers"), F.col("form_trend")
    ppm = F.coalesce(F.col("points_per_million"), F.lit(0.0))
    one = lambda cond: F.when(cond, 1).otherwise(0)
    inj_hi = inj.isNotNull() & (inj >= 8)
    sell_conds = [
        (inj_hi, F.format_string(REASON_INJURY, inj)),
        (form < 2.0, F.format_string(REASON_POOR_FORM, form)),
        (trend == "declining", F.lit(REASON_DECLINING)),
        (fdr.isNotNull() & (fdr >= 4.0), F.format_string(REASON_HARD_FIXTURES, fdr)),
        (score < 30, F.format_string(REASON_LOW_SCORE, score)),
    ]
    sell_n = one(inj_hi) * 2 + one(form < 2.0) + one(trend == "declining") \
        + one(fdr.isNotNull() & (fdr >= 4.0)) + one(score < 30)
    buy_conds = [
        (score >= 65, F.format_string(REASON_STRONG_SCORE, score)),
        (form >= 5.0, F.format_string(REASON_GOOD_FORM, form)),
        (trend == "improving", F.lit(REASON_IMPROVING)),
        (fdr.isNotNull() & (fdr <= 2.5), F.format_string(REASON_EASY_FIXTURES, fdr)),
        (inj.isNotNull() & (inj <= 1), F.lit(REASON_FIT)),
        (ppm >= 5.0, F.format_string(REASON_VALUE, ppm)),
    ]
    buy_n = sum((one(c) for c, _ in buy_conds), F.lit(0))
    sell_r = _reasons(*sell_conds)
    buy_r = _reasons(*buy_conds)
    demand = F.format_string(REASON_DEMAND, F.format_number(net, 0))
    watch_base = F.when(F.size(buy_r) > 0, buy_r).otherwise(sell_r)
    watch_r = F.when(net > 10000, F.concat(watch_base, F.array(demand))).otherwise(watch_base)
    hold_r = F.when(F.size(sell_r) > 0, sell_r).otherwise(F.array(F.format_string(REASON_NO_SIGNAL, score)))
    is_sell = (sell_n >= 2) | (score < 25)
    is_buy = buy_n >= 3
    is_watch = (buy_n >= 2) | ((score >= 55) & (net > 10000))
    rec = F.when(is_sell, "sell").when(is_buy, "buy").when(is_watch, "watch").otherwise("hold")
    reasons = (F.when(is_sell, sell_r).when(is_buy, buy_r).when(is_watch, watch_r).otherwise(hold_r))
    return dash.select("*", rec.alias("recommendation"), reasons.alias("recommendation_reasons"))


def transfer_picks(dash: DataFrame) -> DataFrame:
    """The recommendation projection for every dashboard row."""
    c = classify(dash)
    return c.select("player_id", "web_name", "team_name", "team_short", "position", "price",
                    "composite_score", "composite_rank", "recommendation", "recommendation_reasons",
                    "form", "form_trend", "injury_risk", "fdr_next_3", "net_transfers",
                    "points_per_million", "llm_summary", "injury_reasoning", "season", "gameweek",
                    "src_pos")


def recommendation_counts(picks: DataFrame) -> DataFrame:
    """Count per recommendation plus the 'all' total (one ROLLUP pass)."""
    r = picks.rollup("recommendation").agg(F.count(F.lit(1)).alias("n"))
    return r.select(F.coalesce(F.col("recommendation"), F.lit("all")).alias("recommendation"), "n")


def exact_sum_1dp(c):
    """Sum of a 1-dp column in DECIMAL: exact, so independent of row order."""
    return F.sum(F.col(c).cast("decimal(18,1)")).cast("double")


def exact_mean_1dp(c):
    return exact_sum_1dp(c) / F.count(F.col(c)).cast("double")


def team_strength(dash: DataFrame, fdr: DataFrame, season: str, gameweek: int) -> DataFrame:
    """A4: per-team means/sums, top scorer (first max in input order), counts.

    One partial+final hash aggregate on team; the top scorer is ``max_by``
    on (points, -src_pos) so ties resolve to the earliest row.
    """
    g = dash.groupBy("team_id", "team_name", "team_short").agg(
        F.bround(exact_mean_1dp("composite_score"), 1).alias("avg_composite_score"),
        F.sum("total_points").cast("bigint").alias("total_points"),
        F.bround(exact_mean_1dp("form"), 1).alias("avg_form"),
        F.bround(exact_sum_1dp("price"), 1).alias("squad_value"),
        F.max_by(F.struct("player_id", "web_name", "total_points"),
                 F.struct(F.col("total_points"), -F.col("src_pos"))).alias("_top"),
        F.count(F.lit(1)).alias("player_count"),
        F.count("llm_summary").alias("enriched_player_count"))
    g = g.join(fdr, "team_id", "left")
    return g.select(
        "team_id", "team_name", "team_short", "avg_composite_score", "total_points", "avg_form",
        "squad_value", F.col("_top.player_id").alias("top_scorer_id"),
        F.col("_top.web_name").alias("top_scorer_name"),
        F.col("_top.total_points").alias("top_scorer_points"),
        F.bround("fdr_next_6", 1).alias("avg_fdr_remaining"),
        "player_count", "enriched_player_count",
        F.lit(season).alias("season"), F.lit(gameweek).cast("int").alias("gameweek"))


def briefing_stats(dash: DataFrame, picks: DataFrame) -> DataFrame:
    """Summary counters in one aggregate."""
    return picks.agg(
        F.count(F.lit(1)).alias("total_players"),
        F.count_if(F.col("recommendation") == "buy").alias("buy_count"),
        F.count_if(F.col("recommendation") == "sell").alias("sell_count"),
        F.count_if(F.col("injury_risk") >= 5).alias("injury_count"),
        F.count_if(F.col("form_trend") == "improving").alias("improving_count"),
        F.count_if(F.col("form_trend") == "declining").alias("declining_count"))


def theme_topk(dash: DataFrame, top_players: int = 50, k: int = 5) -> DataFrame:
    """A5: themes of the top-50 players (by rank, id), counted; top k by
    (count desc, first appearance).  Both limits are the feature."""
    top = dash.orderBy(F.col("composite_rank").asc(), F.col("player_id").asc()).limit(top_players)
    th = top.select("composite_rank", "player_id", F.posexplode("key_themes").alias("tpos", "theme"))
    g = th.groupBy("theme").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.struct("composite_rank", "player_id", "tpos")).alias("_first"))
    return (g.orderBy(F.col("n").desc(), F.col("_first").asc()).limit(k)
             .select("theme", "n"))


def briefing_lists(dash: DataFrame, picks: DataFrame, fdr: DataFrame, teams: DataFrame) -> DataFrame:
    """The briefing's top-k lists in long form (list, pos, id).

    Every list is an ``orderBy(...).limit(k)`` (TakeOrderedAndProject, a
    map-side top-k); the lists are unioned, never collected.
    """
    def ranked(df, name, order, k, id_col, detail, pos_order=None):
        d = df.orderBy(*order).limit(k)
        # Position inside the list: a window over at most k rows (O4: the
        # worst runs are the tail of the ascending list, kept ascending).
        w = Window.orderBy(*(pos_order or order))
        return d.select(F.lit(name).alias("list"), F.row_number().over(w).alias("pos"),
                        F.col(id_col).cast("bigint").alias("item_id"), detail.alias("detail"))

    # Each pick's dashboard detail (summary) attached by id, null if missing.
    summaries = dash.select("player_id", F.col("llm_summary").alias("_summary"))
    buys = picks.where(F.col("recommendation") == "buy").drop("llm_summary") \
                .join(summaries, "player_id", "left")
    sells = picks.where(F.col("recommendation") == "sell")
    inj = dash.where(F.col("injury_risk") >= 5)
    rising = dash.where(F.col("form_trend") == "improving")
    falling = dash.where(F.col("form_trend") == "declining")
    tf = with_team_names(fdr, teams, "team_id", "team_").select(
        "team_id", "team_short", F.bround("fdr_next_3", 1).alias("f3"), F.bround("fdr_next_6", 1).alias("f6"))
    parts = [
        ranked(buys, "top_picks", [F.col("composite_score").desc(), F.col("src_pos")], 3, "player_id",
               F.concat(F.concat_ws("|", F.slice("recommendation_reasons", 1, 3)), F.lit("::"),
                        F.coalesce(F.col("_summary"), F.lit("")))),
        ranked(sells, "sell_alerts", [F.col("composite_score").asc(), F.col("src_pos")], 3, "player_id",
               F.concat_ws("|", F.slice("recommendation_reasons", 1, 2))),
        ranked(inj, "injury_alerts", [F.col("injury_risk").desc(), F.col("src_pos")], 5, "player_id",
               F.col("injury_risk").cast("string")),
        ranked(tf, "best_fixtures", [F.col("f6").asc(), F.col("team_id")], 3, "team_id",
               F.format_string("%.1f", F.col("f6"))),
        ranked(tf, "worst_fixtures", [F.col("f6").desc(), F.col("team_id").desc()], 3, "team_id",
               pos_order=[F.col("f6").asc(), F.col("team_id").asc()], detail=
               F.format_string("%.1f", F.col("f6"))),
        ranked(rising, "rising_players", [F.col("composite_score").desc(), F.col("src_pos")], 5, "player_id",
               F.format_string("%.1f", F.col("composite_score"))),
        ranked(falling, "falling_players", [F.col("composite_score").asc(), F.col("src_pos")], 5, "player_id",
               F.format_string("%.1f", F.col("composite_score"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


HISTORY_FIELDS = [
    "player_id", "web_name", "team_short", "position", "gameweek", "season", "total_points",
    "form", "price", "ownership_pct", "composite_score", "composite_rank", "form_trend", "injury_risk",
    "sentiment_score", "fdr_next_3", "net_transfers", "points_per_million",
]


def history_rows(dash: DataFrame) -> DataFrame:
    return dash.select(*HISTORY_FIELDS)


def upsert_history(existing: DataFrame, new_rows: DataFrame) -> DataFrame:
    """U1 functional form: drop existing rows of the (season, gameweek)s being
    written, append the new rows.  The anti-join is on the partition keys of
    the new batch (a small distinct list), so the big history is only
    filtered, never shuffled by player.  On storage the same operation is a
    dynamic partition overwrite (see ``sources.sinks.write_history``)."""
    keys = new_rows.select("season", "gameweek").distinct()
    kept = existing.join(keys, ["season", "gameweek"], "left_anti")
    return kept.unionByName(new_rows.select(*existing.columns))


def latest_gate(history: DataFrame, season: str, gameweek: int) -> DataFrame:
    """Publish the 'latest' document iff (season, gameweek) is not older
    than the newest (season, gameweek) in history (reference ignored season)."""
    mx = history.agg(F.max(F.struct("season", "gameweek")).alias("m"))
    cur = F.struct(F.lit(season).alias("season"), F.lit(gameweek).alias("gameweek"))
    return mx.select(F.lit(season).alias("season"), F.lit(gameweek).cast("int").alias("gameweek"),
                     F.col("m.season").alias("max_season"), F.col("m.gameweek").alias("max_gameweek"),
                     (F.col("m").isNull() | (cur >= F.col("m"))).alias("publish"))


def latest_gate_many(history: DataFrame, candidates: DataFrame) -> DataFrame:
    """S10 for many candidate (season, gameweek) pairs: one max aggregate
    over history (one row, broadcast) compared as a (season, gameweek) pair."""
    mx = history.agg(F.max(F.struct("season", "gameweek")).alias("m"))
    j = candidates.crossJoin(F.broadcast(mx))
    cur = F.struct(F.col("season"), F.col("gameweek"))
    return j.select("season", "gameweek", F.col("m.season").alias("max_season"),
                    F.col("m.gameweek").alias("max_gameweek"),
                    (F.col("m").isNull() | (cur >= F.col("m"))).alias("publish"))


BRIEFING_LISTS = ["top_picks", "sell_alerts", "injury_alerts", "best_fixtures", "worst_fixtures",
                  "rising_players", "falling_players"]


def briefing_document(lists: DataFrame, stats: DataFrame, themes: DataFrame, season: str, gameweek: int,
                      advice_gw) -> DataFrame:
    """A8 as ONE nested document row: each list becomes an array of
    (pos, item_id, detail) structs in list order (every list is a bounded
    top-k, so each collect holds at most k items), plus the summary counters
    and the trending themes; ``to_json`` of the row is the public document."""
    per = lists.groupBy("list").agg(F.array_sort(F.collect_list(F.struct("pos", "item_id", "detail"))).alias("items"))
    wide = per.groupBy().pivot("list", BRIEFING_LISTS).agg(F.first("items"))
    th = themes.agg(F.collect_list(F.struct("theme", "n")).alias("trending_themes"))
    doc = wide.crossJoin(th).crossJoin(stats.select(F.struct(*stats.columns).alias("summary_stats")))
    return doc.select(F.lit(season).alias("season"), F.lit(gameweek).cast("int").alias("gameweek"),
                      F.lit(advice_gw).cast("int").alias("advice_gameweek"),
                      *[F.coalesce(F.col(c), F.array().cast(per.schema["items"].dataType)).alias(c)
                        for c in BRIEFING_LISTS],
                      "trending_themes", "summary_stats")
