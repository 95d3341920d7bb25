"""Look-ups, enrichment contracts and batching, ledger, evaluation."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.operators import enrich, evals, insights, ledger, lookup
from tests.conftest import rows

DASH = ("player_id bigint, web_name string, position string, price double, form double, team_name string, "
        "total_points bigint")


@pytest.fixture()
def dash(spark):
    return spark.createDataFrame([
        (1, "Salah", "MID", 13.0, 8.0, "Liverpool", 200), (2, "Saka", "MID", 10.0, 6.0, "Arsenal", 180),
        (3, "Sakai", "DEF", 4.5, 2.0, "Leeds", 40), (4, "Raya", "GKP", 5.5, 4.0, "Arsenal", 120),
        (5, "Haaland", "FWD", 14.0, 9.0, "Man City", 210)], DASH)


def test_criteria_search_optional_filters_and_limit(spark, dash):
    req = spark.createDataFrame([(1, "mid", 11.0, None, None, 20), (2, None, None, 3.0, "arsen", 1),
                                 (3, "fwd", 5.0, None, None, 20)],
                                "request_id bigint, position string, max_price double, min_form double, "
                                "team string, lim int")
    got = rows(lookup.criteria_search(dash, req), "request_id", "rank", "player_id")
    assert got == [(1, 1, 2), (2, 1, 2)]


def test_name_lookup_best_by_points_and_not_found(spark, dash):
    req = spark.createDataFrame([(1, "sak"), (2, "zzz"), (3, "SALAH")], "request_id bigint, name string")
    got = rows(lookup.name_lookup(dash, req), "request_id", "player_id", "found")
    assert got == [(1, 2, True), (2, None, False), (3, 1, True)]


def test_word_boundary_saka_not_sakai(spark):
    df = spark.createDataFrame([("Sakai played well",), ("SAKA scored",), ("Ødegaard-Saka combo",)], "t string")
    got = [r.m for r in df.select(evals.word_match(F.col("t"), F.lit("Saka")).alias("m")).collect()]
    assert got == [False, True, True]


def test_knn_self_excluded_and_zero_vector(spark):
    base = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, [0.0, 0.0])],
                                 "vec_id long, embedding array<float>")
    q = base.where("vec_id = 1")
    got = rows(lookup.knn_exact(q, base, 10, "vec_id", "vec_id", "embedding"), "rank", "vec_id")
    assert got[0] == (1, 2) and all(v != 1 for _, v in got) and len(got) == 3


def test_keyed_upsert_and_vector_parse(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, seq int")
    new = spark.createDataFrame([(2, "c", 5), (2, "d", 6), (3, "e", 1)], "k int, v string, seq int")
    assert rows(lookup.keyed_upsert(old, new, "k", "seq"), "k", "v") == [(1, "a"), (2, "d"), (3, "e")]
    t = spark.createDataFrame([("[0.5,1.5]",), ("",)], "s string")
    got = [r.v for r in t.select(lookup.parse_vector("s").alias("v")).collect()]
    assert got == [[0.5, 1.5], []]


def test_canned_squad_shape_forced_player_and_sparse_league(spark):
    data, pid = [], 0
    for pos, n in [("GKP", 3), ("DEF", 6), ("MID", 6), ("FWD", 4)]:
        for i in range(n):
            pid += 1
            data.append((1, pid, f"P{pid}", pos, 100 - i, pid))
    data.append((1, 99, "Salah", "MID", 1, 99))
    data.append((2, 200, "Lonely", "GKP", 5, 200))
    pool = spark.createDataFrame(data, "league int, player_id bigint, web_name string, position string, "
                                       "total_points bigint, src_pos bigint")
    s = lookup.canned_squads(pool, "league", "salah").orderBy("league", "slot").collect()
    l1 = [r for r in s if r.league == 1]
    assert len(l1) == 15 and [r.slot for r in l1] == list(range(1, 16))
    assert sum(r.slot <= 11 for r in l1) == 11
    mids = [r.player_id for r in l1 if r.position == "MID"]
    assert 99 in mids and [r for r in l1 if r.player_id == 99][0].slot <= 11
    assert sum(r.is_captain for r in l1) == 1 and sum(r.is_vice_captain for r in l1) == 1
    l2 = [r for r in s if r.league == 2]
    assert len(l2) == 1 and l2[0].reason is not None


def test_squad_enrich_unknown_and_split(spark):
    players = spark.createDataFrame([(1, "A", "T1", 5.0)], "player_id bigint, web_name string, team_name string, "
                                                           "price double")
    picks = ('[{"element":1,"position":1,"multiplier":2,"is_captain":true,"is_vice_captain":false,"element_type":1},'
             '{"element":9,"position":12,"multiplier":0,"is_captain":false,"is_vice_captain":true,"element_type":2}]')
    sq = spark.createDataFrame([(7, picks)], "squad_id bigint, picks_json string")
    e = lookup.enrich_picks(sq, players)
    assert rows(e, "element", "web_name", "team_name", "price") == [(1, "A", "T1", 5.0), (9, "#9", "Unknown", 0.0)]
    s = lookup.split_squad(e).collect()[0]
    assert (s.starters, s.bench, s.captain, s.vice_captain) == ("A", "#9", "A", "#9")


def test_enrich_batch_failure_nulls_whole_batch(spark):
    df = spark.createDataFrame([(i,) for i in range(25)], "doc_id long").coalesce(1)

    def fn(batch):
        if any(x["doc_id"] == 12 for x in batch):
            raise RuntimeError("boom")
        return [{"raw": str(x["doc_id"])} for x in batch]

    out = enrich.enrich(df, fn, ["doc_id"], 10, T.StructType([T.StructField("raw", T.StringType())]), "doc_id")
    got = {r.doc_id: r.raw for r in out.collect()}
    assert all(got[i] is None for i in range(10, 20))
    assert got[0] == "0" and got[24] == "24"


def test_validate_output_contract(spark):
    df = spark.createDataFrame([('{"risk_score": 3, "reasoning": "ok", "sources": []}',),
                                ('{"risk_score": 11, "reasoning": "x"}',),
                                ('{"risk_score": 2, "reasoning": "y", "extra": 1}',),
                                ('{"risk_score": 2, "reasoning": ""}',), ("not json",)], "j string")
    got = [r.o is not None for r in
           df.select(enrich.validate_output(F.col("j"), enrich.INJURY_SCHEMA, enrich.injury_checks).alias("o"))
             .collect()]
    assert got == [True, False, False, False, False]


def test_assign_batches_consecutive_within_key(spark):
    df = spark.createDataFrame([("a", i) for i in range(23)] + [("b", i) for i in range(3)], "k string, i int")
    b = enrich.assign_batches(df, ["k"], ["i"], 10)
    got = rows(b, "k", "i", "batch_no", "item_no")
    assert got[0] == ("a", 0, 0, 1) and got[10] == ("a", 10, 1, 1) and got[22] == ("a", 22, 2, 3)
    assert ("b", 2, 0, 3) in got


def test_cost_report_unknown_model_zero_and_fallback(spark):
    usage = spark.createDataFrame([("n", "claude-sonnet-4-6", 1_000_000, 1_000_000), ("n", "mystery", 1_000_000, 0)],
                                  "node string, model string, input_tokens bigint, output_tokens bigint")
    r = {(x.node, x.model): x.cost_usd for x in
         ledger.cost_report(usage, ledger.rates_frame(spark, ledger.ENRICH_RATES)).collect()}
    assert r[("n", "claude-sonnet-4-6")] == Decimal("18.000000") and r[("n", "mystery")] == Decimal("0E-6")
    fb = ledger.with_cost(usage, ledger.rates_frame(spark, ledger.AGENT_RATES), ledger.AGENT_FALLBACK)
    assert {x.model: x.cost_usd for x in fb.collect()}["mystery"] == Decimal("3.000000")


def test_budget_admission_exclusive_running_sum(spark):
    p = spark.createDataFrame([(1, "d", 1, Decimal("4")), (2, "d", 2, Decimal("4")), (3, "d", 3, Decimal("4")),
                               (4, "d", 4, Decimal("4")), (5, "e", 1, Decimal("11"))],
                              "id int, day string, t int, cost_usd decimal(18,6)")
    a = rows(ledger.budget_admission(p, "day", ["t", "id"], "10"), "id", "allowed", "crossed")
    assert a == [(1, True, False), (2, True, False), (3, True, True), (4, False, False), (5, True, True)]


def test_eval_summary_grouping_sets_and_gate(spark):
    checked = spark.createDataFrame([("a", "easy", True, 4.0), ("a", "hard", False, None), ("b", "easy", True, 5.0)],
                                    "category string, difficulty string, passed boolean, judge_overall double")
    s = {(r.level, r.key): r for r in evals.summary(checked).collect()}
    assert s[("all", "all")].total == 3 and s[("all", "all")].mean_judge_score == 4.5
    assert s[("category", "a")].pass_rate == 0.5 and s[("difficulty", "easy")].passed == 2
    g = evals.gate(evals.summary(checked), 0.8).collect()[0]
    assert g.ok is False


def test_captain_and_differentials(spark):
    d = spark.createDataFrame([
        (1, "A", "MID", 300, 5.0, 2.0, 2.0, 100, 5.0), (2, "B", "GKP", 900, 9.0, None, 1.0, 100, 5.0),
        (3, "C", "FWD", 900, 7.0, 4.0, None, 150, 50.0), (4, "D", "DEF", 100, 9.0, 1.0, 2.0, 90, 1.0)],
        "player_id bigint, web_name string, position string, minutes bigint, points_per_game double, xg double, "
        "fdr_next_3 double, total_points bigint, ownership_pct double")
    c = {r.player_id: r for r in insights.captain_candidates(d).collect()}
    assert set(c) == {1, 3}  # GKP and < 270 minutes excluded
    assert c[3].fixture_norm == 50.0 and c[1].form_norm == 0.0 and c[3].form_norm == 100.0
