"""DuckDB oracle SQL, one entry per catalogue key (same output columns)."""

from __future__ import annotations

from tallyframe.plans.oracle_views import GW, SEASON, view, with_views

RAW: dict[str, tuple[str, tuple[str, ...]]] = {}


def oracle(name: str, body: str, *views: str) -> None:
    """Register an oracle; its WITH clause is assembled once every view
    module is imported (see ``resolve``)."""
    RAW[name] = (body, views)


def resolve() -> dict[str, str]:
    return {k: with_views(b, *v) for k, (b, v) in RAW.items()}


def _case_list(pairs):
    """DuckDB: ordered list of the texts whose condition holds."""
    items = ", ".join(f"CASE WHEN {c} THEN {t} END" for c, t in pairs)
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


_F1 = "printf('%.1f', {})"

# --- shared: transfer picks ----------------------------------------------
_SELL = [
    ("injury_risk >= 8", "printf('High injury risk (%d/10)', injury_risk)"),
    ("form < 2.0", "'Poor form (' || " + _F1.format("form") + " || ')'"),
    ("form_trend = 'declining'", "'Declining form trend'"),
    ("fdr_next_3 >= 4.0", "printf('Very hard fixtures (FDR %.1f)', fdr_next_3)"),
    ("composite_score < 30", "'Low FPL score (' || " + _F1.format("composite_score") + " || ')'"),
]
_BUY = [
    ("composite_score >= 65", "'Strong FPL score (' || " + _F1.format("composite_score") + " || ')'"),
    ("form >= 5.0", "'Good form (' || " + _F1.format("form") + " || ')'"),
    ("form_trend = 'improving'", "'Improving form trend'"),
    ("fdr_next_3 <= 2.5", "printf('Favorable fixtures (FDR %.1f)', fdr_next_3)"),
    ("injury_risk <= 1", "'Minimal injury risk'"),
    ("ppm >= 5.0", "printf('Great value (%.1f pts/£m)', ppm)"),
]


def _count(conds, weights=None):
    weights = weights or [1] * len(conds)
    return " + ".join(f"(CASE WHEN {c} THEN {w} ELSE 0 END)" for (c, _), w in zip(conds, weights))


view("v_pick_signals", ("v_dashboard",), f"""
SELECT d.*, {_count(_SELL, [2, 1, 1, 1, 1])} AS sell_n, {_count(_BUY)} AS buy_n,
       {_case_list(_SELL)} AS sell_r, {_case_list(_BUY)} AS buy_r
FROM (SELECT *, coalesce(points_per_million, 0.0::DOUBLE) AS ppm FROM v_dashboard) d""")

view("v_picks", ("v_pick_signals",), """
SELECT s.*,
  CASE WHEN sell_n >= 2 OR composite_score < 25 THEN 'sell' WHEN buy_n >= 3 THEN 'buy'
       WHEN buy_n >= 2 OR (composite_score >= 55 AND net_transfers > 10000) THEN 'watch' ELSE 'hold' END
    AS recommendation,
  CASE WHEN sell_n >= 2 OR composite_score < 25 THEN sell_r
       WHEN buy_n >= 3 THEN buy_r
       WHEN buy_n >= 2 OR (composite_score >= 55 AND net_transfers > 10000) THEN
            list_concat(CASE WHEN len(buy_r) > 0 THEN buy_r ELSE sell_r END,
                        CASE WHEN net_transfers > 10000
                             THEN ['High transfer demand (+' || format('{:,}', net_transfers) || ')']
                             ELSE []::VARCHAR[] END)
       WHEN len(sell_r) > 0 THEN sell_r
       ELSE ['FPL score ' || printf('%.1f', composite_score) || ' — no strong signals'] END
    AS recommendation_reasons
FROM v_pick_signals s""")

# --------------------------------------------------------------------------

oracle("fixture_ticker", "SELECT * REPLACE (strftime(kickoff_time, '%Y-%m-%d %H:%M:%S.%f') AS kickoff_time) FROM v_ticker", "v_ticker")

oracle("fixture_fdr", "SELECT * FROM v_fdr", "v_fdr")

oracle("player_scores", """
SELECT player_id, team_id, composite_score, composite_rank, fdr_next_3, fdr_next_6 FROM v_dashboard""",
       "v_dashboard")

oracle("score_contributions", """
SELECT player_id, score_form, score_value, score_fixtures, score_xg, score_momentum, score_ict,
       score_injury FROM v_dashboard""", "v_dashboard")

oracle("player_dashboard", """
SELECT * REPLACE (array_to_string(key_themes, '|') AS key_themes,
                  array_to_string(best_gameweeks, '|') AS best_gameweeks)
FROM v_dashboard""", "v_dashboard")

oracle("transfer_picks", """
SELECT player_id, web_name, team_name, team_short, position, price, composite_score, composite_rank,
       recommendation, array_to_string(recommendation_reasons, '|') AS recommendation_reasons,
       form, form_trend, injury_risk, fdr_next_3, net_transfers, season, gameweek
FROM v_picks""", "v_picks")

oracle("recommendation_counts", """
SELECT coalesce(recommendation, 'all') AS recommendation, CAST(count(*) AS BIGINT) AS n
FROM v_picks GROUP BY ROLLUP (recommendation)""", "v_picks")

oracle("team_strength", f"""
SELECT d.team_id, d.team_name, d.team_short,
  round_even(CAST(sum(CAST(d.composite_score AS DECIMAL(18,1))) AS DOUBLE) / CAST(count(d.composite_score) AS DOUBLE), 1) AS avg_composite_score,
  CAST(sum(d.total_points) AS BIGINT) AS total_points,
  round_even(CAST(sum(CAST(d.form AS DECIMAL(18,1))) AS DOUBLE) / CAST(count(d.form) AS DOUBLE), 1) AS avg_form,
  round_even(CAST(sum(CAST(d.price AS DECIMAL(18,1))) AS DOUBLE), 1) AS squad_value,
  arg_max(d.player_id, row(d.total_points, -d.src_pos)) AS top_scorer_id,
  arg_max(d.web_name, row(d.total_points, -d.src_pos)) AS top_scorer_name,
  arg_max(d.total_points, row(d.total_points, -d.src_pos)) AS top_scorer_points,
  round_even(any_value(f.fdr_next_6), 1) AS avg_fdr_remaining,
  CAST(count(*) AS BIGINT) AS player_count, CAST(count(d.llm_summary) AS BIGINT) AS enriched_player_count,
  '{SEASON}' AS season, CAST({GW} AS INTEGER) AS gameweek
FROM v_dashboard d LEFT JOIN v_fdr f ON d.team_id = f.team_id
GROUP BY d.team_id, d.team_name, d.team_short""", "v_dashboard", "v_fdr")

oracle("theme_topk", """
SELECT theme, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT composite_rank, player_id, unnest(generate_series(1, len(key_themes))) AS tpos,
         unnest(key_themes) AS theme
  FROM (SELECT * FROM v_dashboard ORDER BY composite_rank, player_id LIMIT 50) t) x
GROUP BY theme ORDER BY n DESC, min(row(composite_rank, player_id, tpos)) LIMIT 5""", "v_dashboard")

oracle("briefing_stats", """
SELECT CAST(count(*) AS BIGINT) AS total_players,
       CAST(count_if(recommendation = 'buy') AS BIGINT) AS buy_count,
       CAST(count_if(recommendation = 'sell') AS BIGINT) AS sell_count,
       CAST(count_if(injury_risk >= 5) AS BIGINT) AS injury_count,
       CAST(count_if(form_trend = 'improving') AS BIGINT) AS improving_count,
       CAST(count_if(form_trend = 'declining') AS BIGINT) AS declining_count
FROM v_picks""", "v_picks")


def _list(name, src, where, order, k, id_col, detail):
    return (f"(SELECT '{name}' AS list, CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS pos, "
            f"CAST({id_col} AS BIGINT) AS item_id, {detail} AS detail FROM {src} WHERE {where} "
            f"ORDER BY {order} LIMIT {k})")


view("v_team_fdr", ("v_fdr", "v_teams"), """
SELECT f.team_id, coalesce(t.team_short, '???') AS team_short,
       round_even(f.fdr_next_3, 1) AS f3, round_even(f.fdr_next_6, 1) AS f6
FROM v_fdr f LEFT JOIN v_teams t ON f.team_id = t.team_id""")

oracle("briefing_lists", "\nUNION ALL\n".join([
    _list("top_picks", "v_picks", "recommendation = 'buy'", "composite_score DESC, src_pos", 3, "player_id",
          "array_to_string(recommendation_reasons[1:3], '|') || '::' || coalesce(llm_summary, '')"),
    _list("sell_alerts", "v_picks", "recommendation = 'sell'", "composite_score ASC, src_pos", 3, "player_id",
          "array_to_string(recommendation_reasons[1:2], '|')"),
    _list("injury_alerts", "v_dashboard", "injury_risk >= 5", "injury_risk DESC, src_pos", 5, "player_id",
          "CAST(injury_risk AS VARCHAR)"),
    _list("best_fixtures", "v_team_fdr", "true", "f6 ASC, team_id", 3, "team_id", "printf('%.1f', f6)"),
    ("(SELECT 'worst_fixtures' AS list, CAST(row_number() OVER (ORDER BY f6, team_id) AS INTEGER) AS pos, "
     "CAST(team_id AS BIGINT) AS item_id, printf('%.1f', f6) AS detail "
     "FROM (SELECT * FROM v_team_fdr ORDER BY f6 DESC, team_id DESC LIMIT 3) w)"),
    _list("rising_players", "v_dashboard", "form_trend = 'improving'", "composite_score DESC, src_pos", 5,
          "player_id", "printf('%.1f', composite_score)"),
    _list("falling_players", "v_dashboard", "form_trend = 'declining'", "composite_score ASC, src_pos", 5,
          "player_id", "printf('%.1f', composite_score)"),
]), "v_picks", "v_dashboard", "v_team_fdr")

oracle("upcoming_fixtures", f"""
SELECT p.player_id, p.team_id, coalesce(t.n, 0) AS n_fixtures, coalesce(t.shown, '') AS upcoming
FROM v_players p LEFT JOIN (
  SELECT r.team_id, CAST(count(*) AS BIGINT) AS n,
         string_agg(r.gameweek || '|' || r.fixture_id || '|' || coalesce(o.team_name, 'Team ' || r.opp_id) || '|'
                    || r.side || '|' || CAST(r.fdr AS INTEGER), ';'
                    ORDER BY r.gameweek, r.kickoff_time NULLS FIRST, r.fixture_id) AS shown
  FROM (
    SELECT fixture_id, event AS gameweek, kickoff_time, team_h AS team_id, team_a AS opp_id, 'H' AS side,
           coalesce(team_h_difficulty, 3) AS fdr FROM v_fixtures WHERE event > {GW} AND event <= {GW + 5}
    UNION ALL
    SELECT fixture_id, event AS gameweek, kickoff_time, team_a AS team_id, team_h AS opp_id, 'A' AS side,
           coalesce(team_a_difficulty, 3) AS fdr FROM v_fixtures WHERE event > {GW} AND event <= {GW + 5}
  ) r LEFT JOIN v_teams o ON r.opp_id = o.team_id GROUP BY r.team_id) t
ON p.team_id = t.team_id""", "v_players", "v_fixtures", "v_teams")
