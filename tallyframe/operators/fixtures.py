"""Fixture operators: remaining-fixture ticker, per-team difficulty
averages, upcoming-fixture attachment, difficulty grid and rolling swing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Default difficulty and the unknown-team placeholders.
DEFAULT_FDR = 3
UNKNOWN_SHORT = "???"


def with_team_names(df: DataFrame, teams: DataFrame, id_col: str, prefix: str) -> DataFrame:
    """Left look-up of name/short by team id with ``Team {id}``/``???`` defaults.

    ``teams`` is a dimension table; the join is left to Catalyst/AQE, which
    broadcasts it only when its measured size is under the threshold.
    """
    tm = teams.select(F.col("team_id").alias("_tid"), F.col("team_name").alias("_tname"),
                      F.col("team_short").alias("_tshort"))
    out = df.join(tm, df[id_col] == tm["_tid"], "left")
    return out.select(
        *[F.col(f"`{c}`") for c in df.columns],
        F.coalesce(F.col("_tname"), F.concat(F.lit("Team "), F.col(id_col).cast("string"))).alias(f"{prefix}name"),
        F.coalesce(F.col("_tshort"), F.lit(UNKNOWN_SHORT)).alias(f"{prefix}short"))


def remaining_fixtures(fixtures: DataFrame, current_gw: int) -> DataFrame:
    """Fixtures with a known event after the current gameweek (callers that
    derive the event from a date push the equivalent date bound to the scan)."""
    return fixtures.where(F.col("event").isNotNull() & (F.col("event") > F.lit(current_gw)))


def unpivot_home_away(fixtures: DataFrame) -> DataFrame:
    """One pass turning each match into a home row and an away row."""
    home = F.struct(F.col("team_h").alias("team_id"), F.col("team_a").alias("opp_id"),
                    F.lit(True).alias("is_home"),
                    F.coalesce(F.col("team_h_difficulty"), F.lit(DEFAULT_FDR)).alias("fdr"))
    away = F.struct(F.col("team_a").alias("team_id"), F.col("team_h").alias("opp_id"),
                    F.lit(False).alias("is_home"),
                    F.coalesce(F.col("team_a_difficulty"), F.lit(DEFAULT_FDR)).alias("fdr"))
    return fixtures.select("fixture_id", F.col("event").alias("gameweek"), "kickoff_time",
                           F.inline(F.array(home, away)))


def fixture_ticker(fixtures: DataFrame, teams: DataFrame, current_gw: int, season: str) -> DataFrame:
    """P14+P15+J2: the ticker rows (team, gameweek, opponent, home/away, fdr)."""
    rows = unpivot_home_away(remaining_fixtures(fixtures, current_gw))
    rows = with_team_names(rows, teams, "team_id", "team_")
    rows = with_team_names(rows, teams, "opp_id", "opp_")
    return rows.select(
        "fixture_id", "team_id", "team_name", "team_short", "gameweek",
        F.col("opp_name").alias("opponent"), F.col("opp_short").alias("opponent_short"),
        "is_home", F.col("fdr").cast("int").alias("fdr"), "kickoff_time",
        F.lit(season).alias("season"))


def next_n_per_team(rows: DataFrame, n: int) -> DataFrame:
    """The first ``n`` fixtures of every team in (gameweek, kickoff, id) order.

    ``row_number() <= n`` lets Catalyst insert a partial WindowGroupLimit
    before the shuffle, so a team with a third of all rows still ships only
    ``n`` rows per map task.
    """
    w = Window.partitionBy("team_id").orderBy(F.col("gameweek").asc(),
                                              F.col("kickoff_time").asc_nulls_first(),
                                              F.col("fixture_id").asc())
    return rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def fixture_fdr(rows: DataFrame) -> DataFrame:
    """A3: mean difficulty of each team's next 3 and next 6 fixtures."""
    top = next_n_per_team(rows.select("team_id", "gameweek", "kickoff_time", "fixture_id", "fdr"), 6)
    return top.groupBy("team_id").agg(
        F.avg(F.when(F.col("rn") <= 3, F.col("fdr"))).alias("fdr_next_3"),
        F.avg("fdr").alias("fdr_next_6"))


# Parts of a team's players: a team's fixtures are joined to each part apart.
PLAYER_PARTS = 16


def upcoming_fixtures(players: DataFrame, fixtures: DataFrame, teams: DataFrame,
                      gameweek: int, window: int = 5,
                      shown: Callable[[Column], dict[str, Column]] | None = None) -> DataFrame:
    """Each player with their team's fixtures of ``gameweek < event <=
    gameweek + window``, sorted by (event, kickoff, id).

    The fixtures are gathered once per team (as many as it plays in the
    window) and joined to the players as an array: as many rows out as
    players, whatever the window.  A team without fixtures gives an empty
    array.

    ``shown`` makes other columns of that array in its place; they are made
    once per team, not for each of its players.
    """
    f = fixtures.where(F.col("event").isNotNull() & (F.col("event") > gameweek)
                       & (F.col("event") <= gameweek + window))
    rows = unpivot_home_away(f)
    rows = with_team_names(rows, teams, "opp_id", "opp_")
    item = F.struct("gameweek", "kickoff_time", "fixture_id", F.col("opp_name").alias("opponent"), "is_home",
                    F.col("fdr").cast("int").alias("fdr"))
    per_team = rows.groupBy("team_id").agg(F.array_sort(F.collect_list(item)).alias("upcoming"))
    cols = shown or (lambda c: {"upcoming": c})
    none = cols(F.array().cast(per_team.schema["upcoming"].dataType))
    per_team = per_team.select("team_id", *[c.alias(name) for name, c in cols(F.col("upcoming")).items()])
    # A few teams have all the players: each team's are spread over PLAYER_PARTS.
    per_team = per_team.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PLAYER_PARTS - 1).cast("long"))))
    p = players.select("player_id", "team_id", F.pmod(F.xxhash64("player_id"), F.lit(PLAYER_PARTS)).alias("_part"))
    joined = p.join(per_team, ["team_id", "_part"], "left")
    return joined.select("player_id", "team_id", *[F.coalesce(name, c).alias(name) for name, c in none.items()])


def fixture_grid(rows: DataFrame, teams_df: DataFrame) -> DataFrame:
    """Dense team x gameweek grid; a cell keeps the last fixture of the
    gameweek (``max_by`` on fixture id), empty cells count as difficulty 3."""
    cells = rows.groupBy("team_id", "gameweek").agg(
        F.max_by(F.struct("opponent_short", "is_home", "fdr"), F.col("fixture_id")).alias("c"))
    team_ids = rows.select("team_id").distinct()
    # The gameweeks of the data as ONE row (an array bounded by the season's
    # gameweek count), exploded per team: the dense spine without a join of
    # two tables.
    gws = rows.agg(F.array_sort(F.collect_set("gameweek")).alias("_gws"))
    spine = team_ids.crossJoin(F.broadcast(gws)).select("team_id", F.explode("_gws").alias("gameweek"))
    g = spine.join(cells, ["team_id", "gameweek"], "left")
    return g.select("team_id", "gameweek",
                    F.col("c.opponent_short").alias("opponent_short"),
                    F.col("c.is_home").alias("is_home"),
                    F.coalesce(F.col("c.fdr"), F.lit(DEFAULT_FDR)).cast("int").alias("fdr"))


def fixture_grid_sums(grid: DataFrame) -> DataFrame:
    """A22 row sums and banding of the mean (<=2.8 easy, >=3.5 hard)."""
    g = grid.groupBy("team_id").agg(F.sum("fdr").cast("bigint").alias("fdr_sum"),
                                     F.count(F.lit(1)).alias("n_gw"))
    mean = F.col("fdr_sum") / F.col("n_gw")
    return g.select("team_id", "fdr_sum",
                    F.when(mean <= 2.8, "easy").when(mean >= 3.5, "hard").otherwise("medium").alias("band"))


def fixture_swing(grid: DataFrame, span: int = 3, top: int = 3) -> DataFrame:
    """Rolling ``span``-gameweek mean difficulty over the dense grid, then
    each team's mean of the rolling series; the ``top`` easiest teams."""
    w = Window.partitionBy("team_id").orderBy("gameweek").rangeBetween(0, span - 1)
    r = grid.withColumn("roll", F.avg("fdr").over(w))
    # No swing at all with fewer than ``span`` gameweeks (one-row count).
    enough = grid.agg((F.count_distinct("gameweek") >= span).alias("_ok"))
    r = r.crossJoin(F.broadcast(enough)).where("_ok").drop("_ok")
    t = r.groupBy("team_id").agg(F.avg("roll").alias("swing"))
    t = t.select("team_id", F.bround("swing", 4).alias("swing"))
    # orderBy+limit plans TakeOrderedAndProject: a map-side top-k, no
    # single-partition sort.
    return t.orderBy(F.col("swing").asc(), F.col("team_id").asc()).limit(top)
