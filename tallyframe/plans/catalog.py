"""The query catalogue: one named query per operator family in SURVEY §2.

Each entry takes ``(spark, sf_dir)`` and returns a DataFrame over the whole
supplied tables (or data Spark derives from them).  Its DuckDB twin lives
under the same key in ``tallyframe.plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.operators import curate, fixtures as fx
from tallyframe.plans.context import Context, flat
from tallyframe.session import long_values

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


TS_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def result_boundary(df: DataFrame) -> DataFrame:
    """Timestamps leave a query as ISO text with microseconds, so a result
    hashes the same whatever the client's timestamp unit or zone."""
    ts = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))]
    if not ts:
        return df
    return df.select(*[F.date_format(F.col(f"`{c}`"), TS_FORMAT).alias(c) if c in ts else F.col(f"`{c}`")
                       for c in df.columns])


def query(name: str):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return result_boundary(fn(Context.get(spark, sf_dir)))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        return fn
    return deco


# --- minimum slice: fixtures -> difficulty -> scores -> dashboard ----------

@query("fixture_ticker")
def _(c: Context):
    """Remaining fixtures as home/away ticker rows."""
    return c.ticker


@query("fixture_fdr")
def _(c: Context):
    """Mean difficulty of each team's next 3 / 6 fixtures."""
    return c.fdr


@query("player_scores")
def _(c: Context):
    """Composite score and min-rank."""
    return c.dashboard_shared.select("player_id", "team_id", "composite_score", "composite_rank",
                              "fdr_next_3", "fdr_next_6")


@query("score_contributions")
def _(c: Context):
    """A1: the seven rounded weighted contributions."""
    return c.dashboard_shared.select("player_id", "score_form", "score_value", "score_fixtures",
                              "score_xg", "score_momentum", "score_ict", "score_injury")


@query("player_dashboard")
def _(c: Context):
    """The dashboard contract (arrays flattened with '|')."""
    return flat(c.dashboard)  # the flagship keeps its full plan (no checkpoint)


# --- curated set ------------------------------------------------------------

@query("transfer_picks")
def _(c: Context):
    """buy/sell/hold/watch and ordered reasons."""
    return flat(c.picks_shared.select("player_id", "web_name", "team_name", "team_short", "position",
                               "price", "composite_score", "composite_rank", "recommendation",
                               "recommendation_reasons", "form", "form_trend", "injury_risk",
                               "fdr_next_3", "net_transfers", "season", "gameweek"))


@query("recommendation_counts")
def _(c: Context):
    """Counts per recommendation plus 'all' (ROLLUP)."""
    return curate.recommendation_counts(c.picks_shared)


@query("team_strength")
def _(c: Context):
    """Per-team aggregates and top scorer."""
    return curate.team_strength(c.dashboard_shared, c.fdr_shared, c.season, c.gw).orderBy("team_name")


@query("theme_topk")
def _(c: Context):
    """A5: top-5 themes among the top-50 players."""
    return curate.theme_topk(c.dashboard_shared)


@query("briefing_stats")
def _(c: Context):
    """Briefing summary counters."""
    return curate.briefing_stats(c.dashboard_shared, c.picks_shared)


@query("briefing_lists")
def _(c: Context):
    """The briefing's top-k lists in long form."""
    return curate.briefing_lists(c.dashboard_shared, c.picks_shared, c.fdr_shared, c.teams)


# --- fixture insights -------------------------------------------------------

@query("upcoming_fixtures")
def _(c: Context):
    """Each player with their team's fixtures of the next 5 gameweeks
    (the sorted array shown as text)."""
    def shown(upcoming):
        text = F.transform(upcoming, lambda x: F.concat_ws(
            "|", x["gameweek"].cast("string"), x["fixture_id"].cast("string"), x["opponent"],
            F.when(x["is_home"], "H").otherwise("A"), x["fdr"].cast("string")))
        return {"n_fixtures": F.size(upcoming).cast("bigint"), "upcoming": F.array_join(text, ";")}
    # A team's text grows with its fixtures and every player of the team has it.
    long_values(c.spark, "upcoming")
    return fx.upcoming_fixtures(c.players, c.fixtures_window(5), c.teams, c.gw, 5, shown)
