"""Catalogue entries: dashboard insights (P27-P33 A16-A33 W5-W7 J12 J13 J16
J17 O1 O7-O11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions.text import truncate_sentences
from tallyframe.operators import curate, fixtures as fx, insights as ins
from tallyframe.plans.catalog import query
from tallyframe.plans.context import Context, flat
from tallyframe.plans.oracle import oracle
from tallyframe.plans.oracle_views import GW, SEASON, view
from tallyframe.sources import standins

# --- captain ----------------------------------------------------------------------

view("v_cap_e", ("v_dashboard",), """
SELECT player_id, web_name, position, ownership_pct, fdr_next_3, points_per_game AS ppg,
       CASE WHEN xg IS NOT NULL AND minutes > 0 THEN xg / minutes * 90 ELSE 0.0::DOUBLE END AS xg90,
       CAST(total_points AS DOUBLE) AS pts
FROM v_dashboard WHERE minutes >= 270 AND position IN ('MID', 'FWD', 'DEF')""")


def _mm(c, lo, hi):
    return f"CASE WHEN {hi} = {lo} THEN 50.0::DOUBLE ELSE ({c} - {lo}) / ({hi} - {lo}) * 100 END"


view("v_cap", ("v_cap_e",), f"""
SELECT *, form_norm * 0.3::DOUBLE + xg90_norm * 0.2::DOUBLE + fixture_norm * 0.2::DOUBLE
          + points_norm * 0.15::DOUBLE + ownership_norm * 0.15::DOUBLE AS captain_score FROM (
  SELECT e.player_id, e.web_name, e.position, e.ownership_pct,
         {_mm('e.ppg', 's.ppg_lo', 's.ppg_hi')} AS form_norm,
         {_mm('e.xg90', 's.xg_lo', 's.xg_hi')} AS xg90_norm,
         CASE WHEN e.fdr_next_3 IS NOT NULL THEN (5.0::DOUBLE - e.fdr_next_3) / 4 * 100 ELSE 50.0::DOUBLE END AS fixture_norm,
         {_mm('e.pts', 's.pts_lo', 's.pts_hi')} AS points_norm,
         least(e.ownership_pct, 100.0::DOUBLE) AS ownership_norm
  FROM v_cap_e e CROSS JOIN (SELECT min(ppg) ppg_lo, max(ppg) ppg_hi, min(xg90) xg_lo, max(xg90) xg_hi,
                                    min(pts) pts_lo, max(pts) pts_hi FROM v_cap_e) s) x""")

view("v_cap_top15", ("v_cap",), """
SELECT *, CAST(row_number() OVER (ORDER BY captain_score DESC, player_id) AS INTEGER) AS rank
FROM v_cap ORDER BY captain_score DESC, player_id LIMIT 15""")


def _cands(c: Context):
    return ins.captain_candidates(c.dashboard_shared)


@query("captain_scores")
def _(c: Context):
    """Top 15 captain candidates."""
    t = ins.top_captains(_cands(c), 15)
    return t.select("rank", "player_id", F.bround("captain_score", 6).alias("captain_score"))


oracle("captain_scores", """
SELECT rank, player_id, round_even(captain_score, 6) AS captain_score FROM v_cap_top15""", "v_cap_top15")


@query("captain_differentials")
def _(c: Context):
    """Top 25 by captain score, then ownership < 10."""
    return ins.captain_differentials(_cands(c)).select("rank", "player_id", "ownership_pct")


oracle("captain_differentials", """
SELECT rank, player_id, ownership_pct FROM (
  SELECT *, CAST(row_number() OVER (ORDER BY captain_score DESC, player_id) AS INTEGER) AS rank
  FROM v_cap ORDER BY captain_score DESC, player_id LIMIT 25) t
WHERE ownership_pct < 10""", "v_cap")


@query("captain_factor_share")
def _(c: Context):
    """Factor shares of the top 15 and each factor's shown range."""
    return ins.factor_shares(ins.top_captains(_cands(c), 15))


_FACT = [("form", "form_norm", "0.3"), ("xg", "xg90_norm", "0.2"), ("fixture", "fixture_norm", "0.2"),
         ("points", "points_norm", "0.15"), ("ownership", "ownership_norm", "0.15")]
_TOT = " + ".join(f"{c} * {w}::DOUBLE" for _, c, w in _FACT)
view("v_factors", ("v_cap_top15",), "\nUNION ALL\n".join(
    f"SELECT player_id, '{n}' AS factor, {c} AS value, {c} * {w}::DOUBLE AS weighted, {_TOT} AS tot FROM v_cap_top15"
    for n, c, w in _FACT))
oracle("captain_factor_share", """
SELECT player_id, factor,
       round_even(CASE WHEN tot = 0 THEN 20.0::DOUBLE ELSE weighted / tot * 100 END, 6) AS share,
       round_even(min(value) OVER (PARTITION BY factor), 6) AS factor_min,
       round_even(max(value) OVER (PARTITION BY factor), 6) AS factor_max
FROM v_factors""", "v_factors")

# --- differentials, medians, quadrants, outliers ------------------------------------------

view("v_diff", ("v_dashboard",), """
SELECT player_id, web_name, position, ownership_pct, composite_score, llm_summary,
       composite_score * (1 - ownership_pct / 100) AS differential_score
FROM v_dashboard WHERE ownership_pct < 15""")


@query("differential_radar")
def _(c: Context):
    """Top 12 low-ownership differentials."""
    d = ins.differentials(c.dashboard_shared)
    t = d.orderBy(F.col("differential_score").desc(), F.col("player_id")).limit(12)
    from pyspark.sql import Window
    w = Window.orderBy(F.col("differential_score").desc(), F.col("player_id"))
    return t.select(F.row_number().over(w).alias("rank"), "player_id",
                    F.bround("differential_score", 6).alias("differential_score"),
                    truncate_sentences("llm_summary", 2).alias("summary_short"))


oracle("differential_radar", """
SELECT CAST(row_number() OVER (ORDER BY differential_score DESC, player_id) AS INTEGER) AS rank, player_id,
       round_even(differential_score, 6) AS differential_score,
       CASE WHEN llm_summary IS NULL THEN NULL
            WHEN len(regexp_extract_all(llm_summary, '[^.!?]+[.!?]+')) = 0 THEN substring(llm_summary, 1, 120)
            ELSE trim(array_to_string(regexp_extract_all(llm_summary, '[^.!?]+[.!?]+')[1:2], ' ')) END
         AS summary_short
FROM v_diff ORDER BY differential_score DESC, player_id LIMIT 12""", "v_diff")


def _team_strength(c: Context):
    return curate.team_strength(c.dashboard_shared, c.fdr_shared, c.season, c.gw)


def _medians(c: Context):
    d = ins.differentials(c.dashboard_shared)
    ts = _team_strength(c)
    return (ins.exact_median(d, "ownership_pct", "med_own", bounded=True)
            .crossJoin(ins.exact_median(d, "composite_score", "med_diff_score", bounded=True))
            .crossJoin(ins.upper_median(ts, "avg_composite_score", "med_score", 48.0, bounded=True))
            .crossJoin(ins.upper_median(ts.where(F.col("avg_fdr_remaining").isNotNull()),
                                        "avg_fdr_remaining", "med_fdr", 3.0, bounded=True)))


@query("league_medians")
def _(c: Context):
    """Exact medians of the differentials; upper medians of teams."""
    return _medians(c)


def _exact_med(col, src):
    return f"""(SELECT coalesce((max(CASE WHEN rn = (n - 1) // 2 THEN v END)
                         + max(CASE WHEN rn = n // 2 THEN v END)) / 2, 0.0::DOUBLE) FROM (
  SELECT {col} AS v, row_number() OVER (ORDER BY {col}) - 1 AS rn, count(*) OVER () AS n
  FROM {src} WHERE {col} IS NOT NULL) z)"""


def _upper_med(col, src, default):
    return f"""(SELECT coalesce(CAST(max(CASE WHEN rn = n // 2 THEN v END) AS DOUBLE), {default}::DOUBLE) FROM (
  SELECT {col} AS v, row_number() OVER (ORDER BY {col}) - 1 AS rn, count(*) OVER () AS n
  FROM {src} WHERE {col} IS NOT NULL) z)"""


_TS_SQL = """
SELECT d.team_id, d.team_name,
  round_even(CAST(sum(CAST(d.composite_score AS DECIMAL(18,1))) AS DOUBLE) / CAST(count(d.composite_score) AS DOUBLE), 1) AS avg_composite_score,
  round_even(any_value(f.fdr_next_6), 1) AS avg_fdr_remaining
FROM v_dashboard d LEFT JOIN v_fdr f ON d.team_id = f.team_id GROUP BY d.team_id, d.team_name"""
view("v_ts", ("v_dashboard", "v_fdr"), _TS_SQL)
view("v_medians", ("v_diff", "v_ts"), f"""
SELECT {_exact_med('ownership_pct', 'v_diff')} AS med_own, {_exact_med('composite_score', 'v_diff')} AS med_diff_score,
       {_upper_med('avg_composite_score', 'v_ts', 48.0)} AS med_score,
       {_upper_med('avg_fdr_remaining', 'v_ts', 3.0)} AS med_fdr""")
oracle("league_medians", "SELECT * FROM v_medians", "v_medians")


@query("value_quadrants")
def _(c: Context):
    """Team quadrant against the median score and difficulty."""
    m = _medians(c).select("med_score", "med_fdr")
    return ins.quadrants(_team_strength(c), m)


oracle("value_quadrants", """
SELECT t.team_id, t.team_name, t.avg_composite_score, t.avg_fdr_remaining,
       CASE WHEN t.avg_composite_score >= m.med_score AND t.avg_fdr_remaining <= m.med_fdr THEN 'strong_easy'
            WHEN t.avg_composite_score < m.med_score AND t.avg_fdr_remaining > m.med_fdr THEN 'weak_hard'
            ELSE 'other' END AS quadrant
FROM v_ts t CROSS JOIN v_medians m WHERE t.avg_fdr_remaining IS NOT NULL""", "v_ts", "v_medians")


view("v_own_med", ("v_dashboard",), f"""
SELECT {_upper_med('ownership_pct', 'v_dashboard', 10.0)} AS m_own,
       {_upper_med('points_per_million', 'v_dashboard', 15.0)} AS m_ppm""")


@query("ownership_outliers")
def _(c: Context):
    """Top 3 differentials (own < median, value > median) and 2 traps."""
    d = c.dashboard_shared
    med = (ins.upper_median(d, "ownership_pct", "m_own", 10.0, bounded=True)
           .crossJoin(ins.upper_median(d, "points_per_million", "m_ppm", 15.0, bounded=True)))
    j = d.select("player_id", "ownership_pct", "points_per_million").crossJoin(F.broadcast(med))
    a = (j.where((F.col("ownership_pct") < F.col("m_own")) & (F.col("points_per_million") > F.col("m_ppm")))
          .orderBy(F.col("points_per_million").desc(), "player_id").limit(3)
          .select(F.lit("differential").alias("kind"), "player_id"))
    b = (j.where((F.col("ownership_pct") > F.col("m_own")) & (F.col("points_per_million") < F.col("m_ppm")))
          .orderBy(F.col("points_per_million").asc(), "player_id").limit(2)
          .select(F.lit("trap").alias("kind"), "player_id"))
    return a.unionByName(b)


oracle("ownership_outliers", f"""
WITH_M
SELECT 'differential' AS kind, player_id FROM (
  SELECT d.player_id, d.points_per_million FROM v_dashboard d, m
  WHERE d.ownership_pct < m.m_own AND d.points_per_million > m.m_ppm
  ORDER BY d.points_per_million DESC, d.player_id LIMIT 3) a
UNION ALL
SELECT 'trap', player_id FROM (
  SELECT d.player_id, d.points_per_million FROM v_dashboard d, m
  WHERE d.ownership_pct > m.m_own AND d.points_per_million < m.m_ppm
  ORDER BY d.points_per_million ASC, d.player_id LIMIT 2) b""".replace("WITH_M\n", "").replace(
    "FROM v_dashboard d, m", "FROM v_dashboard d, v_own_med m"), "v_own_med")



@query("xg_outliers")
def _(c: Context):
    """Top 5 by |goals - xG| and the p99 axis cap ceil(p99 + 1)."""
    d = c.dashboard_shared.where(F.col("xg").isNotNull())
    vals = d.select(F.explode(F.array(F.col("xg"), F.col("goals_scored").cast("double"))).alias("v"))
    p99 = ins.order_stats(vals, "v", {"_p": F.floor(F.col("_n") * 0.99)}) \
             .select(F.ceil(F.coalesce(F.col("_p"), F.lit(1.0)) + 1).cast("bigint").alias("axis_max"))
    top = (d.select("player_id", F.abs(F.col("goals_scored") - F.col("xg")).alias("delta"))
            .orderBy(F.col("delta").desc(), "player_id").limit(5))
    return top.crossJoin(F.broadcast(p99))


oracle("xg_outliers", """
SELECT t.player_id, t.delta, a.axis_max FROM (
  SELECT player_id, abs(goals_scored - xg) AS delta FROM v_dashboard WHERE xg IS NOT NULL
  ORDER BY delta DESC, player_id LIMIT 5) t
CROSS JOIN (SELECT CAST(ceil(coalesce(max(CASE WHEN rn = CAST(floor(n * 0.99) AS BIGINT) THEN v END), 1.0) + 1) AS BIGINT)
                   AS axis_max FROM (
   SELECT v, row_number() OVER (ORDER BY v) - 1 AS rn, count(*) OVER () AS n FROM (
     SELECT xg AS v FROM v_dashboard WHERE xg IS NOT NULL
     UNION ALL SELECT CAST(goals_scored AS DOUBLE) FROM v_dashboard WHERE xg IS NOT NULL) u) z) a""",
       "v_dashboard")

# --- fixture grid / swing ---------------------------------------------------------------------


def _grid(c: Context):
    return fx.fixture_grid(c.ticker, c.teams)


@query("fixture_grid")
def _(c: Context):
    """Dense team x gameweek difficulty grid; row sums and banding."""
    g = _grid(c)
    return g.join(fx.fixture_grid_sums(g), "team_id", "inner")


view("v_grid", ("v_ticker",), """
SELECT s.team_id, s.gameweek, c.opponent_short, c.is_home, CAST(coalesce(c.fdr, 3) AS INTEGER) AS fdr FROM
  (SELECT t.team_id, g.gameweek FROM (SELECT DISTINCT team_id FROM v_ticker) t,
                                     (SELECT DISTINCT gameweek FROM v_ticker) g) s
LEFT JOIN (SELECT team_id, gameweek,
                  arg_max(opponent_short, fixture_id) AS opponent_short, arg_max(is_home, fixture_id) AS is_home,
                  arg_max(fdr, fixture_id) AS fdr
           FROM v_ticker GROUP BY team_id, gameweek) c
  ON s.team_id = c.team_id AND s.gameweek = c.gameweek""")
oracle("fixture_grid", """
SELECT g.*, s.fdr_sum, s.band FROM v_grid g JOIN (
  SELECT team_id, CAST(sum(fdr) AS BIGINT) AS fdr_sum,
         CASE WHEN sum(fdr) / count(*) <= 2.8 THEN 'easy' WHEN sum(fdr) / count(*) >= 3.5 THEN 'hard'
              ELSE 'medium' END AS band
  FROM v_grid GROUP BY team_id) s ON g.team_id = s.team_id""", "v_grid")

_GWS = list(range(GW + 1, GW + 11))


@query("fixture_grid_pivot")
def _(c: Context):
    """A22 wide form: one column per gameweek (explicit value list)."""
    p = _grid(c).groupBy("team_id").pivot("gameweek", _GWS).agg(F.first("fdr"))
    return p.select("team_id", *[F.col(str(g)).alias(f"gw_{g}") for g in _GWS])


oracle("fixture_grid_pivot", "SELECT team_id, " + ", ".join(
    f"max(CASE WHEN gameweek = {g} THEN fdr END) AS gw_{g}" for g in _GWS)
    + " FROM v_grid GROUP BY team_id", "v_grid")


@query("fixture_swing")
def _(c: Context):
    """Rolling 3-gameweek difficulty, team mean, 3 easiest teams."""
    return fx.fixture_swing(_grid(c))


oracle("fixture_swing", """
SELECT team_id, round_even(avg(roll), 4) AS swing FROM (
  SELECT team_id, avg(fdr) OVER (PARTITION BY team_id ORDER BY gameweek RANGE BETWEEN CURRENT ROW AND 2 FOLLOWING)
         AS roll FROM v_grid) x
WHERE (SELECT count(DISTINCT gameweek) FROM v_grid) >= 3
GROUP BY team_id ORDER BY swing, team_id LIMIT 3""", "v_grid")

# --- history -----------------------------------------------------------------------------------

view("v_history", (), f"""
SELECT player_id, gameweek, season, composite_score, price, ownership_pct, sentiment_score,
       CAST(rank() OVER (PARTITION BY season, gameweek ORDER BY composite_score DESC) AS BIGINT) AS composite_rank
FROM (SELECT user_id AS player_id, CAST(day(ts) AS INTEGER) AS gameweek, '{SEASON}' AS season,
             round_even(CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / CAST(count(*) AS DOUBLE), 1) AS composite_score,
             round_even(min(value) / 10, 1) AS price, CAST(count(*) AS DOUBLE) AS ownership_pct,
             ((user_id % 21) - 10) / 10.0::DOUBLE AS sentiment_score
      FROM events GROUP BY user_id, CAST(day(ts) AS INTEGER)) x""")


def _hist(c: Context):
    return standins.history(c.t)


@query("player_history")
def _(c: Context):
    """Per-player ordered history rows (the history stand-in)."""
    return _hist(c)


oracle("player_history", "SELECT * FROM v_history", "v_history")

HIST_GWS = list(range(1, 31))


@query("momentum_matrix")
def _(c: Context):
    """Top 50 by latest rank x gameweek score matrix."""
    m = ins.momentum_matrix(_hist(c), 30, HIST_GWS)
    return m.select("player_id", *[F.col(str(g)).alias(f"gw_{g}") for g in HIST_GWS])


oracle("momentum_matrix", "SELECT h.player_id, " + ", ".join(
    f"max(CASE WHEN gameweek = {g} THEN composite_score END) AS gw_{g}" for g in HIST_GWS) + """
FROM v_history h WHERE player_id IN (
  SELECT player_id FROM v_history WHERE gameweek = 30 ORDER BY composite_rank, player_id LIMIT 50)
GROUP BY h.player_id""", "v_history")


@query("score_series")
def _(c: Context):
    """Dense score series (missing -> 0) for the 10 best-ranked
    players of the latest gameweek."""
    h = _hist(c)
    sel = h.where(F.col("gameweek") == 30).orderBy(F.col("composite_rank"), F.col("player_id")).limit(10) \
           .select("player_id")
    return ins.score_series(h, sel, 1, 30)


oracle("score_series", """
SELECT s.player_id, s.gameweek, coalesce(h.composite_score, 0.0::DOUBLE) AS composite_score FROM (
  SELECT p.player_id, CAST(g.gameweek AS INTEGER) AS gameweek FROM (
    SELECT player_id FROM v_history WHERE gameweek = 30 ORDER BY composite_rank, player_id LIMIT 10) p,
    range(1, 31) g(gameweek)) s
LEFT JOIN v_history h ON s.player_id = h.player_id AND s.gameweek = h.gameweek""", "v_history")


@query("last10")
def _(c: Context):
    """Last 10 scores per player in gameweek order."""
    return flat(ins.last_n(_hist(c), 10))


oracle("last10", """
SELECT season, player_id, string_agg(CAST(composite_score AS VARCHAR), '|' ORDER BY gameweek) AS last_scores FROM (
  SELECT *, row_number() OVER (PARTITION BY season, player_id ORDER BY gameweek DESC) AS r FROM v_history) x
WHERE r <= 10 GROUP BY season, player_id""", "v_history")


@query("movers")
def _(c: Context):
    """First-vs-last gameweek risers and fallers."""
    return ins.movers(_hist(c), 1, 30, 5)


view("v_deltas", ("v_history",), """
SELECT player_id, round_even(max(CASE WHEN gameweek = 30 THEN composite_score END)
                           - max(CASE WHEN gameweek = 1 THEN composite_score END), 1) AS delta,
       round_even(max(CASE WHEN gameweek = 30 THEN price END)
                  - max(CASE WHEN gameweek = 1 THEN price END), 1) AS price_delta,
       round_even(max(CASE WHEN gameweek = 30 THEN ownership_pct END)
                  - max(CASE WHEN gameweek = 1 THEN ownership_pct END), 1) AS ownership_delta
FROM v_history WHERE gameweek IN (1, 30) GROUP BY player_id
HAVING count(CASE WHEN gameweek = 1 THEN 1 END) > 0 AND count(CASE WHEN gameweek = 30 THEN 1 END) > 0""")
oracle("movers", """
SELECT * FROM (SELECT 'riser' AS kind, * FROM v_deltas ORDER BY delta DESC, player_id LIMIT 5)
UNION ALL
SELECT * FROM (SELECT 'faller' AS kind, * FROM v_deltas ORDER BY delta ASC, player_id LIMIT 5)""",
       "v_deltas")

# --- breakdown, radar, banding -------------------------------------------------------------------


@query("score_breakdown")
def _(c: Context):
    """Positive score components in long form."""
    return ins.score_breakdown(c.dashboard_shared)


oracle("score_breakdown", "\nUNION ALL\n".join(
    f"SELECT player_id, '{x}' AS component, coalesce({x}, 0.0::DOUBLE) AS value FROM v_dashboard "
    f"WHERE coalesce({x}, 0.0::DOUBLE) > 0" for x in ins.COMPONENTS), "v_dashboard")


@query("radar")
def _(c: Context):
    """Six normalised stats per player (long form)."""
    return ins.radar(c.dashboard_shared)


_RADAR = [("Goals", "CAST(goals_scored AS DOUBLE)", "greatest(CAST(goals_scored AS DOUBLE), 20.0::DOUBLE)"),
          ("Assists", "CAST(assists AS DOUBLE)", "greatest(CAST(assists AS DOUBLE), 15.0::DOUBLE)"),
          ("xG", "coalesce(xg, CAST(goals_scored AS DOUBLE) * 0.8::DOUBLE)", "20.0::DOUBLE"),
          ("Creativity", "creativity / 10", "100.0::DOUBLE"), ("Threat", "threat / 10", "100.0::DOUBLE"),
          ("ICT", "ict_index / 3", "100.0::DOUBLE")]
oracle("radar", "\nUNION ALL\n".join(
    f"SELECT player_id, '{n}' AS stat, round_even(least({v} / {m} * 100, 100.0::DOUBLE), 6) AS value FROM v_dashboard"
    for n, v, m in _RADAR), "v_dashboard")


@query("banding")
def _(c: Context):
    """Display bands (difficulty class, colours, tier, sentiment, heat)."""
    return ins.banding(c.dashboard_shared)


oracle("banding", """
SELECT d.player_id,
  CAST(least(greatest(floor(coalesce(fdr_next_3, 3.0::DOUBLE) + 0.5), 1), 5) AS INTEGER) AS fdr_class,
  CASE WHEN composite_score >= 65 THEN 'green' WHEN composite_score >= 45 THEN 'neutral' ELSE 'red' END AS score_colour,
  CASE WHEN composite_score >= 65 THEN 'green' WHEN composite_score >= 50 THEN 'emerald' WHEN composite_score >= 40 THEN 'amber'
       WHEN composite_score >= 30 THEN 'orange' ELSE 'red' END AS score_bar,
  CASE WHEN composite_rank <= 20 THEN 'Elite' WHEN composite_rank <= 50 THEN 'High Value' END AS tier,
  CASE WHEN sentiment_score IS NULL THEN 'none' WHEN sentiment_score > 0.3 THEN 'strong_positive'
       WHEN sentiment_score > 0 THEN 'positive' WHEN sentiment_score < -0.3 THEN 'strong_negative'
       WHEN sentiment_score < 0 THEN 'negative' ELSE 'zero' END AS sentiment_band,
  CASE WHEN r.hi = r.lo THEN '' WHEN (points_per_million - r.lo) / (r.hi - r.lo) > 0.7 THEN 'high'
       WHEN (points_per_million - r.lo) / (r.hi - r.lo) < 0.3 THEN 'low' ELSE '' END AS ppm_heat
FROM v_dashboard d CROSS JOIN (SELECT min(points_per_million) lo, max(points_per_million) hi FROM v_dashboard) r""",
       "v_dashboard")

# --- head-to-head, verdicts, candidates, hub -----------------------------------------------------


@query("head_to_head")
def _(c: Context):
    """Each player against the next id, 12 metrics with a winner."""
    d = c.dashboard_shared
    pairs = d.select(F.col("player_id").alias("a_id")).join(
        d.select((F.col("player_id") - 1).alias("a_id"), F.col("player_id").alias("b_id")), "a_id", "inner") \
        .select(F.col("a_id").alias("pair_id"), "a_id", "b_id")
    return ins.head_to_head(pairs, d)


def _h2h_sql():
    parts = []
    for m, hib in ins.H2H_METRICS:
        op = ">" if hib else "<"
        parts.append(f"""SELECT a.player_id AS pair_id, a.player_id AS a_id, b.player_id AS b_id, '{m}' AS metric,
  CAST(a.{m} AS DOUBLE) AS a_value, CAST(b.{m} AS DOUBLE) AS b_value,
  CASE WHEN a.{m} IS NULL OR b.{m} IS NULL OR CAST(a.{m} AS DOUBLE) = CAST(b.{m} AS DOUBLE) THEN 'tie'
       WHEN CAST(a.{m} AS DOUBLE) {op} CAST(b.{m} AS DOUBLE) THEN 'a' ELSE 'b' END AS better
FROM v_dashboard a JOIN v_dashboard b ON b.player_id = a.player_id + 1""")
    return "\nUNION ALL\n".join(parts)


oracle("head_to_head", _h2h_sql(), "v_dashboard")

_F1 = "printf('%.1f', {})"


def _verdict_sql(s, b):
    diff = f"({b}.composite_score - {s}.composite_score)"
    fs, fb = f"coalesce({s}.fdr_next_3, 3.0::DOUBLE)", f"coalesce({b}.fdr_next_3, 3.0::DOUBLE)"
    pd = f"({s}.price - {b}.price)"
    head = (f"CASE WHEN {diff} > 5 THEN 'Strong upgrade. ' || {b}.web_name || ' scores ' || {_F1.format(diff)} "
            f"|| ' points higher than ' || {s}.web_name || ' on the FPL Score index.' "
            f"WHEN {diff} >= -5 THEN 'Lateral move. The FPL Score difference is only ' || {_F1.format('abs(' + diff + ')')} "
            f"|| ' points — consider the fixture run before committing.' "
            f"ELSE 'Downgrade. ' || {b}.web_name || ' scores ' || {_F1.format('abs(' + diff + ')')} "
            f"|| ' points lower — only worthwhile if you are freeing budget for a bigger upgrade elsewhere.' END")
    fix = (f"CASE WHEN {fs} - {fb} > 0.5 THEN 'Better fixtures ahead: ' || {b}.web_name || ' has an easier next-3 FDR (' "
           f"|| {_F1.format(fb)} || ' vs ' || {_F1.format(fs)} || ').' "
           f"WHEN {fs} - {fb} < -0.5 THEN 'Tougher fixtures ahead: ' || {b}.web_name || ' faces harder games in the next 3 (' "
           f"|| {_F1.format(fb)} || ' vs ' || {_F1.format(fs)} || ').' END")
    price = f"CASE WHEN {pd} > 0.5 THEN 'Frees up £' || {_F1.format(pd)} || 'm in budget.' END"
    return f"concat_ws(' ', {head}, {fix}, {price})"


view("v_buy_cands", ("v_picks", "v_dashboard"), f"""
SELECT * FROM (
  SELECT s.player_id AS sell_id, b.player_id AS buy_id,
         CAST(row_number() OVER (PARTITION BY s.player_id ORDER BY b.composite_score DESC, b.player_id) AS INTEGER) AS rank,
         {_verdict_sql('s', 'b')} AS verdict, round_even(s.price - b.price, 1) AS price_delta
  FROM v_picks s JOIN v_dashboard b ON s.position = b.position AND s.player_id <> b.player_id
  WHERE s.recommendation = 'sell') x
WHERE rank <= 50""")


def _cands_buy(c: Context):
    sells = c.picks_shared.where(F.col("recommendation") == "sell").select("player_id", "position", "web_name",
                                                                    "composite_score", "fdr_next_3", "price")
    return ins.buy_candidates(sells, c.dashboard_shared, 50)


@query("buy_candidates")
def _(c: Context):
    """Top 50 same-position replacements for every sell, with verdicts."""
    return _cands_buy(c)


oracle("buy_candidates", "SELECT sell_id, rank, buy_id, verdict, price_delta FROM v_buy_cands", "v_buy_cands")


@query("transfer_verdict")
def _(c: Context):
    """The verdict and the price delta for each sell and its best
    replacement."""
    return _cands_buy(c).where(F.col("rank") == 1).select("sell_id", "buy_id", "verdict", "price_delta")


oracle("transfer_verdict", "SELECT sell_id, buy_id, verdict, price_delta FROM v_buy_cands WHERE rank = 1",
       "v_buy_cands")


@query("score_pyramid")
def _(c: Context):
    """Score components of each sell (mirrored) and its best replacement."""
    return ins.score_pyramid(_cands_buy(c).where(F.col("rank") == 1), c.dashboard_shared)


oracle("score_pyramid", "\nUNION ALL\n".join(
    f"SELECT v.sell_id, v.buy_id, '{x}' AS component, 0.0::DOUBLE - coalesce(s.{x}, 0.0::DOUBLE) AS sell, "
    f"coalesce(b.{x}, 0.0::DOUBLE) AS buy FROM v_buy_cands v JOIN v_dashboard s ON v.sell_id = s.player_id "
    f"JOIN v_dashboard b ON v.buy_id = b.player_id WHERE v.rank = 1" for x in ins.COMPONENTS),
    "v_buy_cands", "v_dashboard")


@query("transfer_hub")
def _(c: Context):
    """30 easiest-fixture picks (null difficulty treated as 3)."""
    return ins.transfer_hub(c.picks_shared, "fdr_next_3", 30)


oracle("transfer_hub", """
SELECT CAST(row_number() OVER (ORDER BY coalesce(fdr_next_3, 3.0::DOUBLE), player_id) AS INTEGER) AS rank,
       player_id, recommendation, coalesce(fdr_next_3, 3.0::DOUBLE) AS sort_value
FROM v_picks ORDER BY coalesce(fdr_next_3, 3.0::DOUBLE), player_id LIMIT 30""", "v_picks")


@query("transfer_hub_filtered")
def _(c: Context):
    """The 30 best-scored midfielders to sell."""
    return ins.transfer_hub(c.picks_shared, "composite_score", 30, recommendation="sell", position="MID")


oracle("transfer_hub_filtered", """
SELECT CAST(row_number() OVER (ORDER BY coalesce(composite_score, 0.0::DOUBLE) DESC, player_id) AS INTEGER) AS rank,
       player_id, recommendation, coalesce(composite_score, 0.0::DOUBLE) AS sort_value
FROM v_picks WHERE recommendation = 'sell' AND position = 'MID'
ORDER BY coalesce(composite_score, 0.0::DOUBLE) DESC, player_id LIMIT 30""", "v_picks")

# --- gameweek resolve, coverage, profile, distribution, ownership, headline ----------------------


@query("gameweek_resolve")
def _(c: Context):
    """Current / latest finished gameweek, distinct count, run decision."""
    f = c.fixtures.where(F.col("event").isNotNull())
    ev = f.select("event").distinct()
    a = ev.agg(F.max(F.when(F.col("event") <= c.gw, F.col("event"))).alias("latest_finished"),
               F.max(F.when(F.col("event") == c.gw, F.col("event"))).alias("current"),
               F.count(F.lit(1)).alias("n_gameweeks"), F.max("event").alias("last_gameweek"))
    last_done = _hist(c).agg(F.max("gameweek").alias("last_processed"))
    j = a.crossJoin(last_done)
    resolved = F.when(F.coalesce(F.col("current"), F.lit(0)) > 0, F.col("current")).otherwise(F.col("latest_finished"))
    return j.select("current", "latest_finished", "n_gameweeks", "last_gameweek", "last_processed",
                    resolved.alias("resolved"), (resolved > F.col("last_processed")).alias("should_run"))


oracle("gameweek_resolve", f"""
SELECT current, latest_finished, n_gameweeks, last_gameweek, last_processed,
       CASE WHEN coalesce(current, 0) > 0 THEN current ELSE latest_finished END AS resolved,
       CASE WHEN coalesce(current, 0) > 0 THEN current ELSE latest_finished END > last_processed AS should_run
FROM (SELECT max(CASE WHEN event <= {GW} THEN event END) AS latest_finished,
             max(CASE WHEN event = {GW} THEN event END) AS current,
             CAST(count(*) AS BIGINT) AS n_gameweeks, max(event) AS last_gameweek
      FROM (SELECT DISTINCT event FROM v_fixtures WHERE event IS NOT NULL) e) a
CROSS JOIN (SELECT max(gameweek) AS last_processed FROM v_history) h""", "v_fixtures", "v_history")


@query("coverage_stats")
def _(c: Context):
    """Enrichment and fixture coverage counters in one aggregate."""
    up = fx.upcoming_fixtures(c.players, c.fixtures_window(5), c.teams, c.gw, 5).where(F.size("upcoming") > 0)
    up = up.select("player_id").distinct()
    p = c.players.join(up.select("player_id", F.lit(True).alias("_fx")), "player_id", "left")
    return p.agg(F.count(F.lit(1)).alias("players"),
                 F.count_if(F.col("summary").isNotNull()).alias("enriched"),
                 F.count_if(F.col("understat_xg").isNotNull()).alias("with_second_source"),
                 F.count_if(F.col("_fx").isNotNull()).alias("with_fixtures"),
                 F.bround(F.count_if(F.col("summary").isNotNull()) * 100.0 / F.count(F.lit(1)), 2)
                 .alias("enriched_pct"))


oracle("coverage_stats", f"""
SELECT CAST(count(*) AS BIGINT) AS players, CAST(count_if(p.summary IS NOT NULL) AS BIGINT) AS enriched,
       CAST(count_if(p.understat_xg IS NOT NULL) AS BIGINT) AS with_second_source,
       CAST(count_if(u.player_id IS NOT NULL) AS BIGINT) AS with_fixtures,
       round_even(count_if(p.summary IS NOT NULL) * 100.0::DOUBLE / count(*), 2) AS enriched_pct
FROM v_players p LEFT JOIN (
  SELECT DISTINCT p2.player_id FROM v_players p2 JOIN (
    SELECT team_h AS team_id FROM v_fixtures WHERE event > {GW} AND event <= {GW + 5}
    UNION ALL SELECT team_a FROM v_fixtures WHERE event > {GW} AND event <= {GW + 5}) f
  ON p2.team_id = f.team_id) u ON p.player_id = u.player_id""", "v_players", "v_fixtures")


@query("snapshot_profile")
def _(c: Context):
    """Row count, distinct teams and counts per position (long)."""
    d = c.dashboard_shared
    tot = d.agg(F.lit("rows").alias("metric"), F.lit("").alias("key"), F.count(F.lit(1)).alias("value"))
    teams = d.agg(F.lit("teams").alias("metric"), F.lit("").alias("key"),
                  F.count_distinct("team_id").alias("value"))
    pos = d.groupBy(F.coalesce("position", F.lit("?")).alias("key")).agg(F.count(F.lit(1)).alias("value")) \
           .select(F.lit("position").alias("metric"), "key", "value")
    return tot.unionByName(teams).unionByName(pos)


oracle("snapshot_profile", """
SELECT 'rows' AS metric, '' AS key, CAST(count(*) AS BIGINT) AS value FROM v_dashboard
UNION ALL SELECT 'teams', '', CAST(count(DISTINCT team_id) AS BIGINT) FROM v_dashboard
UNION ALL SELECT 'position', coalesce(position, '?'), CAST(count(*) AS BIGINT) FROM v_dashboard
GROUP BY coalesce(position, '?')""", "v_dashboard")


@query("score_distribution")
def _(c: Context):
    """Mean (exact), median, max and min of the composite score."""
    d = c.dashboard_shared
    a = d.agg(F.bround(curate.exact_mean_1dp("composite_score"), 6).alias("mean"),
              F.max("composite_score").alias("max"), F.min("composite_score").alias("min"))
    return a.crossJoin(ins.exact_median(d, "composite_score", "median", bounded=True))


oracle("score_distribution", f"""
SELECT round_even(CAST(sum(CAST(composite_score AS DECIMAL(18,1))) AS DOUBLE) / CAST(count(composite_score) AS DOUBLE), 6) AS mean,
       max(composite_score) AS max, min(composite_score) AS min, {_exact_med('composite_score', 'v_dashboard')} AS median
FROM v_dashboard""", "v_dashboard")


@query("top_by_ownership")
def _(c: Context):
    """O1: the 300 most-owned players (null -> 0; stable by input order)."""
    p = c.players.select("player_id", F.coalesce("selected_by_percent", F.lit(0.0)).alias("own"), "src_pos")
    t = p.orderBy(F.col("own").desc(), F.col("src_pos")).limit(300)
    from pyspark.sql import Window
    return t.select(F.row_number().over(Window.orderBy(F.col("own").desc(), F.col("src_pos"))).alias("rank"),
                    "player_id", "own")


oracle("top_by_ownership", """
SELECT CAST(row_number() OVER (ORDER BY coalesce(selected_by_percent, 0.0::DOUBLE) DESC, src_pos) AS INTEGER) AS rank,
       player_id, coalesce(selected_by_percent, 0.0::DOUBLE) AS own
FROM v_players ORDER BY own DESC, src_pos LIMIT 300""", "v_players")


@query("headline_pick")
def _(c: Context):
    """The first 'buy' in table order."""
    return c.picks_shared.where(F.col("recommendation") == "buy").orderBy("src_pos").limit(1) \
                  .select("player_id", "web_name", "composite_score")


oracle("headline_pick", """
SELECT player_id, web_name, composite_score FROM v_picks WHERE recommendation = 'buy' ORDER BY src_pos LIMIT 1""",
       "v_picks")
