"""Fixture ticker, scoring, dashboard, transfer picks, team strength,
briefing and history (cases from the product's own unit tests)."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import curate, fixtures as fx, scoring
from tests.conftest import rows

TEAMS = [(1, "Arsenal", "ARS"), (2, "Chelsea", "CHE"), (3, "Liverpool", "LIV")]


@pytest.fixture()
def teams(spark):
    return spark.createDataFrame(TEAMS, "team_id int, team_name string, team_short string")


def fixtures_df(spark, data):
    return spark.createDataFrame(data, "fixture_id bigint, event int, team_h int, team_a int, "
                                       "team_h_difficulty int, team_a_difficulty int, kickoff_time timestamp")


def test_ticker_filters_past_and_null_events_and_defaults(spark, teams):
    t = datetime(2025, 1, 1)
    f = fixtures_df(spark, [
        (1, 30, 1, 2, 2, 4, t),          # past gameweek: excluded
        (2, None, 1, 3, 2, 2, t),        # unscheduled: excluded
        (3, 31, 1, 9, None, 3, t),       # null difficulty -> 3, unknown team 9
        (4, 32, 2, 3, 5, 1, None),
    ])
    out = fx.fixture_ticker(f, teams, 30, "s")
    got = rows(out, "fixture_id", "team_id", "team_name", "team_short", "opponent", "is_home", "fdr")
    assert got == [
        (3, 1, "Arsenal", "ARS", "Team 9", True, 3),
        (3, 9, "Team 9", "???", "Arsenal", False, 3),
        (4, 2, "Chelsea", "CHE", "Liverpool", True, 5),
        (4, 3, "Liverpool", "LIV", "Chelsea", False, 1),
    ]


def test_fdr_next_3_and_6_with_fewer_fixtures_and_order(spark, teams):
    t = datetime(2025, 1, 1)
    data = [(i, 30 + i, 1, 2, d, 3, t) for i, d in enumerate([5, 1, 2, 4, 4, 4, 1, 1], start=1)]
    data.append((20, 31, 3, 2, 2, 2, None))  # team 3: one fixture only; kickoff null sorts first
    f = fixtures_df(spark, data)
    fdr = fx.fixture_fdr(fx.fixture_ticker(f, teams, 30, "s"))
    got = {r.team_id: (r.fdr_next_3, r.fdr_next_6) for r in fdr.collect()}
    assert got[1] == pytest.approx(((5 + 1 + 2) / 3, (5 + 1 + 2 + 4 + 4 + 4) / 6))
    assert got[3] == (2.0, 2.0)
    # team 2 plays both the GW31 null-kickoff match (first) and the dated one
    assert got[2][0] == pytest.approx((2 + 3 + 3) / 3)


PLAYER_COLS = ("player_id bigint, team_id int, form double, total_points bigint, now_cost bigint, "
               "goals_scored bigint, understat_xg double, expected_goals double, transfers_in bigint, "
               "transfers_out bigint, ict_index double, injury_risk int")


def test_scores_constant_column_is_50_and_ties_share_rank(spark):
    p = spark.createDataFrame([
        (1, 1, 5.0, 100, 100, 5, None, 4.0, 10, 5, 50.0, 0),
        (2, 1, 5.0, 100, 100, 5, None, 4.0, 10, 5, 50.0, 0),
        (3, 2, 5.0, 50, 0, 1, 2.0, None, 0, 0, 50.0, None),
    ], PLAYER_COLS)
    fdr = spark.createDataFrame([(1, 2.0, 2.0)], "team_id int, fdr_next_3 double, fdr_next_6 double")
    s = {r.player_id: r for r in scoring.compute_scores(p, fdr).collect()}
    # form and ict are constant -> 50; price 0 -> value 0 (min of the column)
    assert s[1].score_form == pytest.approx(round(0.25 * 50, 1))
    assert s[1].score_ict == 5.0
    assert s[3].score_value == 0.0
    # team without difficulty -> 3.0 -> (5-3)/4*100 = 50
    assert s[3].score_fixtures == pytest.approx(round(0.15 * 50, 1))
    # null injury risk -> 2 -> 80
    assert s[3].score_injury == 8.0
    assert s[1].composite_score == s[2].composite_score
    assert s[1].composite_rank == s[2].composite_rank == 1
    assert s[3].composite_rank == 3


def test_bounded_rank_equals_window_rank(spark):
    import random
    from pyspark.sql import Window
    from tallyframe.operators.ranking import min_rank_desc_bounded
    rnd = random.Random(3)
    data = [(i, float(rnd.randint(0, 1000)) / 10) for i in range(3000)]
    df = spark.createDataFrame(data, "id long, score double")
    a = min_rank_desc_bounded(df, "score", "r")
    b = df.withColumn("r", F.rank().over(Window.orderBy(F.col("score").desc())))
    assert rows(a, "id", "r") == rows(b, "id", "r")


# classifier cases: score, form, fdr, injury, net, trend, ppm -> expected
CASES = [
    (75.0, 8.0, 2.0, 0, 50000, "improving", 6.0, "buy"),
    (20.0, 0.5, 4.5, 3, -100000, "declining", 2.0, "sell"),
    (50.0, 4.0, 3.0, 9, -5000, "declining", 4.0, "sell"),
    (45.0, 3.0, 3.0, 2, 1000, "stable", 4.0, "hold"),
    (58.0, 4.0, 3.0, 1, 50000, "stable", 4.5, "watch"),
    (24.9, 5.0, None, None, 0, "stable", 9.0, "sell"),
    (30.0, 2.0, None, None, 10000, "stable", 0.0, "hold"),
    (55.0, 4.0, 3.0, 5, 10001, "stable", 1.0, "watch"),
]


def test_classifier_cases(spark):
    df = spark.createDataFrame(
        [(i, *c[:7]) for i, c in enumerate(CASES)],
        "player_id int, composite_score double, form double, fdr_next_3 double, injury_risk int, "
        "net_transfers bigint, form_trend string, points_per_million double")
    got = {r.player_id: (r.recommendation, r.recommendation_reasons) for r in curate.classify(df).collect()}
    for i, c in enumerate(CASES):
        assert got[i][0] == c[7], (i, got[i])
    assert got[0][1] == ["Strong FPL score (75.0)", "Good form (8.0)", "Improving form trend",
                         "Favorable fixtures (FDR 2.0)", "Minimal injury risk", "Great value (6.0 pts/£m)"]
    assert got[5][1] == ["Low FPL score (24.9)"]
    assert got[6][1] == ["FPL score 30.0 — no strong signals"]
    assert got[7][1] == ["High transfer demand (+10,001)"]


def test_team_strength_small_case(spark):
    dash = spark.createDataFrame([
        (1, "Haaland", 1, "Man City", "MCI", 70.0, 200, 8.0, 14.5, "x", 1),
        (2, "Foden", 1, "Man City", "MCI", 55.0, 171, 6.0, 8.1, None, 2),
        (3, "Salah", 2, "Liverpool", "LIV", 80.0, 171, 9.0, 13.0, "y", 3),
        (4, "Diaz", 2, "Liverpool", "LIV", 40.0, 171, 3.0, 7.5, "z", 4),
    ], "player_id bigint, web_name string, team_id int, team_name string, team_short string, composite_score double, "
       "total_points bigint, form double, price double, llm_summary string, src_pos bigint")
    fdr = spark.createDataFrame([(1, 2.0, 2.25)], "team_id int, fdr_next_3 double, fdr_next_6 double")
    t = {r.team_id: r for r in curate.team_strength(dash, fdr, "s", 1).collect()}
    assert t[1].avg_composite_score == 62.5 and t[1].total_points == 371 and t[1].squad_value == 22.6
    assert t[1].top_scorer_name == "Haaland" and t[1].enriched_player_count == 1
    assert t[1].avg_fdr_remaining == 2.2  # half-even
    assert t[2].top_scorer_name == "Salah"  # tie on points -> first in input order
    assert t[2].avg_fdr_remaining is None


def test_history_upsert_replaces_same_gameweek_and_keeps_other_season(spark):
    cols = "season string, gameweek int, player_id bigint, composite_score double"
    old = spark.createDataFrame([("a", 1, 1, 10.0), ("a", 2, 1, 20.0), ("b", 2, 1, 99.0)], cols)
    new = spark.createDataFrame([("a", 2, 1, 21.0), ("a", 2, 2, 22.0)], cols)
    out = curate.upsert_history(old, new)
    assert rows(out) == [("a", 1, 1, 10.0), ("a", 2, 1, 21.0), ("a", 2, 2, 22.0), ("b", 2, 1, 99.0)]


def test_history_partition_overwrite_on_storage(spark):
    from tallyframe.session import scratch_path
    from tallyframe.sources import sinks
    path = scratch_path(spark, "t-hist")
    cols = "season string, gameweek int, player_id bigint, composite_score double"
    sinks.write_partitioned(spark.createDataFrame([("a", 1, 1, 1.0), ("a", 2, 1, 2.0)], cols), path,
                            ["season", "gameweek"])
    sinks.write_partitioned(spark.createDataFrame([("a", 2, 7, 7.0)], cols), path, ["season", "gameweek"])
    got = rows(sinks.read_partitioned(spark, path), "season", "gameweek", "player_id", "composite_score")
    assert got == [("a", 1, 1, 1.0), ("a", 2, 7, 7.0)]


def test_latest_gate_compares_season_and_gameweek(spark):
    h = spark.createDataFrame([("2025-26", 30)], "season string, gameweek int")
    c = spark.createDataFrame([("2025-26", 29), ("2025-26", 30), ("2026-27", 1)], "season string, gameweek int")
    got = rows(curate.latest_gate_many(h, c), "season", "gameweek", "publish")
    assert got == [("2025-26", 29, False), ("2025-26", 30, True), ("2026-27", 1, True)]
