"""DuckDB twins of the stand-in views and shared intermediate results.

Each entry is ``name -> (dependencies, SQL body)``; ``with_views`` assembles
the WITH clause an oracle query needs.  Numeric literals that must be
doubles are written ``x::DOUBLE`` (a bare ``0.75`` is DECIMAL in DuckDB);
counts and integer sums are cast to BIGINT (DuckDB returns HUGEINT).
"""

from __future__ import annotations

from tallyframe.sources.standins import CURRENT_GW, N_FIXTURE_TEAMS, SEASON

GW = CURRENT_GW

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def view(name: str, deps: tuple[str, ...], sql: str) -> None:
    VIEWS[name] = (deps, sql)


def with_views(body: str, *needed: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in VIEWS[n][0]:
            visit(d)
        order.append(n)

    for n in needed:
        visit(n)
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS (\n{VIEWS[n][1]}\n)" for n in order)
    head = body.lstrip()
    if head.upper().startswith("WITH RECURSIVE"):
        # the body's own (recursive) CTEs continue the WITH clause
        return f"WITH RECURSIVE {ctes},\n{head[len('WITH RECURSIVE'):].lstrip()}"
    return f"WITH {ctes}\n{body}"


# --------------------------------------------------------------------------
# Stand-ins
# --------------------------------------------------------------------------
view("v_player_orders", (), """
SELECT o_custkey AS player_id,
       CAST(count(*) AS BIGINT) AS n_orders,
       CAST(count_if(o_orderstatus = 'F') AS BIGINT) AS n_f,
       CAST(count_if(o_orderstatus = 'O') AS BIGINT) AS n_o,
       CAST(count_if(o_orderstatus = 'P') AS BIGINT) AS n_p,
       CAST(count_if(o_orderpriority = '1-URGENT') AS BIGINT) AS n_urgent,
       CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents,
       max(o_totalprice) AS max_price
FROM orders GROUP BY o_custkey""")

view("v_players_base", ("v_player_orders",), """
SELECT c.c_custkey AS k, c.c_name, c.c_nationkey, c.c_acctbal, c.c_mktsegment,
       coalesce(o.n_orders, 0) AS n, coalesce(o.n_f, 0) AS n_f, coalesce(o.n_o, 0) AS n_o,
       coalesce(o.n_p, 0) AS n_p, coalesce(o.n_urgent, 0) AS n_u, o.cents, o.max_price
FROM customer c LEFT JOIN v_player_orders o ON c.c_custkey = o.player_id""")

view("v_players", ("v_players_base",), f"""
SELECT k AS player_id, c_name AS web_name,
       split_part(c_name, '#', 1) AS first_name,
       CASE WHEN k % 13 = 0 THEN NULL ELSE split_part(c_name, '#', 2) END AS second_name,
       CAST(c_nationkey AS INTEGER) AS team_id,
       CAST(CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2
            WHEN 'FURNITURE' THEN 3 WHEN 'MACHINERY' THEN 4 ELSE 5 END AS INTEGER) AS element_type,
       CAST(floor(greatest(c_acctbal, 0.0::DOUBLE) / 100) AS BIGINT) AS now_cost,
       n + 2 * n_f + 3 * n_u AS total_points,
       90 * n_f + 45 * n_o AS minutes,
       n_f AS goals_scored, n_o AS assists, n_p AS clean_sheets, n_u AS bonus,
       round_even(CAST(cents AS DOUBLE) / CAST(nullif(n, 0) AS DOUBLE) / 5000000.0::DOUBLE, 1) AS form,
       round_even(CAST(n + 2 * n_f + 3 * n_u AS DOUBLE) / CAST(nullif(n, 0) AS DOUBLE), 1) AS points_per_game,
       (k % 100) / 2.0::DOUBLE AS selected_by_percent,
       n_o * 1000 + (k % 7) * 2000 AS transfers_in,
       n_p * 1000 + (k % 3) * 1500 AS transfers_out,
       CASE WHEN k % 3 = 0 THEN NULL ELSE n_f * 0.75::DOUBLE END AS expected_goals,
       CASE WHEN k % 2 = 0 THEN NULL ELSE (n_f + n_p) * 0.5::DOUBLE END AS understat_xg,
       CASE WHEN k % 2 = 0 THEN NULL ELSE n_o * 0.25::DOUBLE END AS understat_xa,
       CASE WHEN k % 2 = 0 THEN NULL ELSE n_p * 0.5::DOUBLE END AS understat_npxg,
       n_f * 10.5::DOUBLE AS influence,
       n_o * 7.25::DOUBLE AS creativity,
       n_p * 12.0::DOUBLE AS threat,
       round_even(max_price / 10000.0::DOUBLE, 1) AS ict_index,
       CASE WHEN k % 5 = 0 THEN NULL
            ELSE c_name || ' has ' || CAST(n AS VARCHAR) || ' orders and steady output.' END AS summary,
       CASE WHEN k % 3 = 0 THEN 'improving' WHEN k % 3 = 1 THEN 'stable' ELSE 'declining' END AS form_trend,
       (k % 10) / 10.0::DOUBLE AS form_confidence,
       CASE WHEN k % 7 = 0 THEN NULL ELSE CAST(k % 11 AS INTEGER) END AS injury_risk,
       CASE WHEN k % 7 = 0 THEN NULL ELSE 'risk ' || CAST(CAST(k % 11 AS INTEGER) AS VARCHAR) END AS injury_reasoning,
       CASE WHEN k % 4 = 0 THEN 'positive' WHEN k % 4 = 1 THEN 'negative'
            WHEN k % 4 = 2 THEN 'neutral' ELSE 'mixed' END AS sentiment_label,
       ((k % 21) - 10) / 10.0::DOUBLE AS sentiment_score,
       list_value(lower(c_mktsegment), CASE WHEN n_u > 2 THEN 'urgent' ELSE 'steady' END) AS key_themes,
       list_value(CAST({GW + 1} + k % 5 AS INTEGER), CAST({GW + 3} + k % 5 AS INTEGER)) AS best_gameweeks,
       'Target GW' || CAST({GW + 1} + k % 10 AS VARCHAR) AS fixture_recommendation,
       k AS src_pos
FROM v_players_base""")

view("v_teams", (), """
SELECT CAST(n_nationkey AS INTEGER) AS team_id, n_name AS team_name,
       'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS team_short
FROM nation""")

view("v_fixtures", (), f"""
SELECT * FROM (
  SELECT o.o_orderkey AS fixture_id,
         CASE WHEN o.o_orderkey % 29 = 0 THEN NULL
              ELSE CAST((year(o.o_orderdate) - 1995) * 12 + month(o.o_orderdate) AS INTEGER) END AS event,
         CAST(c.c_nationkey AS INTEGER) AS team_h,
         CAST(o.o_orderkey % {N_FIXTURE_TEAMS} AS INTEGER) AS team_a,
         CASE WHEN o.o_orderkey % 17 = 0 THEN NULL ELSE CAST(o.o_orderkey % 5 + 1 AS INTEGER) END AS team_h_difficulty,
         CAST(o.o_custkey % 5 + 1 AS INTEGER) AS team_a_difficulty,
         CASE WHEN o.o_orderkey % 23 = 0 THEN NULL ELSE o.o_orderdate END AS kickoff_time
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey) x
WHERE team_h <> team_a""")

# --------------------------------------------------------------------------
# Fixtures
# --------------------------------------------------------------------------
view("v_ticker_rows", ("v_fixtures",), f"""
SELECT fixture_id, event AS gameweek, kickoff_time, team_h AS team_id, team_a AS opp_id,
       true AS is_home, coalesce(team_h_difficulty, 3) AS fdr
FROM v_fixtures WHERE event IS NOT NULL AND event > {GW}
UNION ALL
SELECT fixture_id, event AS gameweek, kickoff_time, team_a AS team_id, team_h AS opp_id,
       false AS is_home, coalesce(team_a_difficulty, 3) AS fdr
FROM v_fixtures WHERE event IS NOT NULL AND event > {GW}""")

view("v_ticker", ("v_ticker_rows", "v_teams"), f"""
SELECT r.fixture_id, r.team_id,
       coalesce(t.team_name, 'Team ' || CAST(r.team_id AS VARCHAR)) AS team_name,
       coalesce(t.team_short, '???') AS team_short, r.gameweek,
       coalesce(o.team_name, 'Team ' || CAST(r.opp_id AS VARCHAR)) AS opponent,
       coalesce(o.team_short, '???') AS opponent_short,
       r.is_home, CAST(r.fdr AS INTEGER) AS fdr, r.kickoff_time, '{SEASON}' AS season
FROM v_ticker_rows r LEFT JOIN v_teams t ON r.team_id = t.team_id
LEFT JOIN v_teams o ON r.opp_id = o.team_id""")

view("v_fdr", ("v_ticker_rows",), """
SELECT team_id, avg(CASE WHEN rn <= 3 THEN fdr END) AS fdr_next_3, avg(fdr) AS fdr_next_6
FROM (SELECT team_id, fdr, row_number() OVER (PARTITION BY team_id
        ORDER BY gameweek, kickoff_time NULLS FIRST, fixture_id) AS rn FROM v_ticker_rows) x
WHERE rn <= 6 GROUP BY team_id""")

# --------------------------------------------------------------------------
# Scoring and dashboard
# --------------------------------------------------------------------------
view("v_score_raw", ("v_players", "v_fdr"), """
SELECT p.*, f.fdr_next_3, f.fdr_next_6,
       coalesce(p.form, 0.0::DOUBLE) AS r_form,
       coalesce(CAST(p.total_points AS DOUBLE) / nullif(CAST(p.now_cost AS DOUBLE) / 10.0::DOUBLE, 0.0::DOUBLE), 0.0::DOUBLE) AS r_value,
       coalesce(p.goals_scored - coalesce(coalesce(p.understat_xg, p.expected_goals), 0.0::DOUBLE), 0.0::DOUBLE) AS r_xg,
       CAST(coalesce(p.transfers_in - p.transfers_out, 0) AS DOUBLE) AS r_mom,
       coalesce(p.ict_index, 0.0::DOUBLE) AS r_ict
FROM v_players p LEFT JOIN v_fdr f ON p.team_id = f.team_id
WHERE p.summary IS NOT NULL""")

_MM = "CASE WHEN hi_{c} = lo_{c} THEN 50.0::DOUBLE ELSE (r_{c} - lo_{c}) / (hi_{c} - lo_{c}) * 100.0::DOUBLE END"


def _mm(c: str) -> str:
    return _MM.format(c=c)


view("v_score_comp", ("v_score_raw",), f"""
SELECT r.*,
       {_mm('form')} AS c_form, {_mm('value')} AS c_value,
       least(greatest((5.0::DOUBLE - coalesce(fdr_next_3, 3.0::DOUBLE)) / 4.0::DOUBLE * 100.0::DOUBLE, 0.0::DOUBLE), 100.0::DOUBLE) AS c_fixtures,
       {_mm('xg')} AS c_xg, {_mm('mom')} AS c_mom, {_mm('ict')} AS c_ict,
       least(greatest(100.0::DOUBLE - CAST(coalesce(injury_risk, 2) AS DOUBLE) * 10.0::DOUBLE, 0.0::DOUBLE), 100.0::DOUBLE) AS c_injury
FROM v_score_raw r CROSS JOIN (
  SELECT min(r_form) lo_form, max(r_form) hi_form, min(r_value) lo_value, max(r_value) hi_value,
         min(r_xg) lo_xg, max(r_xg) hi_xg, min(r_mom) lo_mom, max(r_mom) hi_mom,
         min(r_ict) lo_ict, max(r_ict) hi_ict FROM v_score_raw) s""")

view("v_scores", ("v_score_comp",), """
SELECT x.*, CAST(rank() OVER (ORDER BY composite_score DESC) AS BIGINT) AS composite_rank FROM (
SELECT c.*,
       least(greatest(round_even(0.25::DOUBLE * c_form + 0.15::DOUBLE * c_value + 0.15::DOUBLE * c_fixtures
         + 0.15::DOUBLE * c_xg + 0.1::DOUBLE * c_mom + 0.1::DOUBLE * c_ict + 0.1::DOUBLE * c_injury, 1),
         0.0::DOUBLE), 100.0::DOUBLE) AS composite_score,
       round_even(0.25::DOUBLE * c_form, 1) AS score_form,
       round_even(0.15::DOUBLE * c_value, 1) AS score_value,
       round_even(0.15::DOUBLE * c_fixtures, 1) AS score_fixtures,
       round_even(0.15::DOUBLE * c_xg, 1) AS score_xg,
       round_even(0.1::DOUBLE * c_mom, 1) AS score_momentum,
       round_even(0.1::DOUBLE * c_ict, 1) AS score_ict,
       round_even(0.1::DOUBLE * c_injury, 1) AS score_injury
FROM v_score_comp c) x""")

view("v_dashboard", ("v_scores", "v_teams"), f"""
SELECT s.player_id, s.web_name, s.first_name || ' ' || s.second_name AS full_name,
       s.team_id, coalesce(t.team_name, 'Team ' || CAST(s.team_id AS VARCHAR)) AS team_name,
       coalesce(t.team_short, '???') AS team_short,
       CASE s.element_type WHEN 1 THEN 'GKP' WHEN 2 THEN 'DEF' WHEN 3 THEN 'MID' WHEN 4 THEN 'FWD' END AS position,
       s.total_points, s.minutes, s.goals_scored, s.assists, s.clean_sheets, s.bonus,
       s.form, s.points_per_game,
       round_even(CAST(s.now_cost AS DOUBLE) / 10.0::DOUBLE, 1) AS price,
       s.selected_by_percent AS ownership_pct,
       coalesce(round_even(CAST(s.total_points AS DOUBLE) / nullif(CAST(s.now_cost AS DOUBLE) / 10.0::DOUBLE, 0.0::DOUBLE), 1), 0.0::DOUBLE) AS points_per_million,
       s.transfers_in, s.transfers_out, s.transfers_in - s.transfers_out AS net_transfers,
       s.understat_xg AS xg, s.understat_xa AS xa, s.understat_npxg AS npxg,
       CASE WHEN coalesce(s.understat_xg, s.expected_goals) IS NULL THEN NULL
            ELSE s.goals_scored - coalesce(s.understat_xg, s.expected_goals) END AS xg_delta,
       s.influence, s.creativity, s.threat, s.ict_index,
       s.form_trend, s.form_confidence, s.summary AS llm_summary,
       s.injury_risk, s.injury_reasoning, s.sentiment_label, s.sentiment_score, s.key_themes,
       s.fdr_next_3, s.fdr_next_6, s.best_gameweeks, s.fixture_recommendation,
       s.composite_score, s.composite_rank,
       s.score_form, s.score_value, s.score_fixtures, s.score_xg, s.score_momentum, s.score_ict, s.score_injury,
       '{SEASON}' AS season, CAST({GW} AS INTEGER) AS gameweek, CAST({GW + 1} AS INTEGER) AS advice_gameweek,
       s.src_pos
FROM v_scores s LEFT JOIN v_teams t ON s.team_id = t.team_id""")

_SS_NAME = """CASE WHEN k % 3 = 0 THEN upper(split_part(c_name, '#', 1) || '-' || split_part(c_name, '#', 2))
            WHEN k % 3 = 1 THEN c_name ELSE 'O''' || c_name END"""

view("v_second_source", ("v_players_base",), f"""
SELECT {_SS_NAME} AS player_name, CAST(n_f AS VARCHAR) || '.5' AS "xG",
       CASE WHEN k % 17 = 0 THEN 'n/a' ELSE CAST(n_o AS VARCHAR) END AS shots, k * 2 AS src_pos
FROM v_players_base
UNION ALL
SELECT {_SS_NAME} AS player_name, '99.0' AS "xG", '0' AS shots, k * 2 + 1 AS src_pos
FROM v_players_base WHERE k % 10 = 0""")
