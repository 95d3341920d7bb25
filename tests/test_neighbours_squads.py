"""Exact neighbours by cells, squad documents, case filter, swaps."""

import random

import pytest

from tallyframe.operators import evals, insights, lookup


def vectors(spark, n, dims, seed, spread=1.0):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(dims)] for _ in range(6)]
    out = []
    for i in range(n):
        c = centres[0 if i % 3 == 0 else r.randrange(6)]
        out.append((i, [x + spread * r.gauss(0, 0.3) for x in c]))
    out += [(n + i, out[7][1]) for i in range(n // 10)] + [(5_000, [0.0] * dims), (5_001, None)]
    return spark.createDataFrame(out, "id long, v array<double>")


@pytest.mark.parametrize("n_cells,spread", [(2, 1.0), (12, 1.0), (12, 6.0), (300, 0.2)])
def test_cells_give_the_exact_neighbours(spark, n_cells, spread):
    base = vectors(spark, 240, 8, n_cells, spread)
    q = base.where("id % 9 = 0 OR id = 7").where("id < 5000")
    got = lookup.knn_cells(q, base, 6, "id", "id", "v", n_cells).collect()
    want = lookup.knn_exact(q, base.where("id < 5000"), 6, "id", "id", "v").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 6 * q.count()


def test_few_cells_have_measured_recall(spark):
    base = vectors(spark, 400, 16, 5)
    q = base.where("id % 10 = 0").where("id < 5000")
    want = {(r.query_id, r.id) for r in lookup.knn_exact(q, base.where("id < 5000"), 5, "id", "id", "v").collect()}
    got = {(r.query_id, r.id) for r in lookup.knn_cells(q, base, 5, "id", "id", "v", 16, probes=4).collect()}
    assert len(want & got) / len(want) >= 0.9
    assert lookup.knn_cells(q.limit(0), base, 5, "id", "id", "v", 16).count() == 0


def test_squad_document_in_two_outputs(spark):
    pick = '{"element":%d,"position":%d,"multiplier":1,"is_captain":false,"is_vice_captain":false,"element_type":1}'
    docs = [(1, '{"picks":[%s,%s],"entry_history":{"bank":5,"value":150,"total_points":9,"overall_rank":7},'
                '"active_chip":"wildcard"}' % (pick % (1, 1), pick % (2, 2))),
            (2, '{"picks":[%s],"entry_history":{"bank":5,"value":99}}' % (pick % (1, 1))),
            (3, '{"picks":[%s],"entry_history":{"value":45}}' % (pick % (77, 1))),
            (4, '{"picks":[]}'), (5, "<html>"), (6, None), (7, '{"picks":[%s]}' % (pick % (2, 1)))]
    players = spark.createDataFrame([(1, "A", "T", 4.5), (2, "B", "T", 10.0)],
                                    "player_id long, web_name string, team_name string, price double")
    picks, totals = lookup.squad_documents(spark.createDataFrame(docs, "squad_id int, squad_json string"), players)
    got = {r.squad_id: tuple(r)[1:] for r in totals.collect()}
    assert got == {1: ("ok", 2, 0.5, 15.0, "wildcard", 7, 9, True), 2: ("ok", 1, 0.5, 9.9, None, None, 0, False),
                   3: ("ok", 1, 0.0, 4.5, None, None, 0, None), 4: ("not found", 0, 0.0, 0.0, None, None, 0, None),
                   5: ("unreadable", 0, 0.0, 0.0, None, None, 0, None),
                   6: ("unreadable", 0, 0.0, 0.0, None, None, 0, None), 7: ("ok", 1, 0.0, 0.0, None, None, 0, None)}
    assert sorted((r.squad_id, r.web_name) for r in picks.collect()) == [(1, "A"), (1, "B"), (2, "A"), (3, "#77"), (7, "B")]


def test_ids_win_over_categories_and_the_cap_comes_last(spark):
    cases = spark.createDataFrame([(i, f"c{i % 3}") for i in range(12)], "case_id int, category string")
    ids = lambda **k: [r.case_id for r in evals.filter_cases(cases, **k).orderBy("case_id").collect()]
    assert ids(ids=[5, 1, 99], categories=["c0"]) == [1, 5]
    assert ids(categories=["c0"], max_cases=2) == [0, 3] and ids(max_cases=3) == [0, 1, 2] and len(ids()) == 12
    for wrong in ({"ids": [99]}, {"categories": ["x"]}):
        with pytest.raises(ValueError):
            evals.filter_cases(cases, **wrong)


def test_pyramid_mirrors_the_sell_side(spark):
    cols = ", ".join(f"{c} double" for c in insights.COMPONENTS)
    dash = spark.createDataFrame([(1, *map(float, range(1, 8))), (2, None, *map(float, range(11, 17)))],
                                 f"player_id int, {cols}")
    got = {r.component: (r.sell, r.buy) for r in insights.score_pyramid(
        spark.createDataFrame([(1, 2)], "sell_id int, buy_id int"), dash).collect()}
    assert got["score_form"] == (-1.0, 0.0) and got["score_injury"] == (-7.0, 16.0) and len(got) == 7


@pytest.mark.parametrize("k", [1, 6, 90])
def test_exact_neighbours_in_tiles(spark, monkeypatch, k):
    monkeypatch.setattr(lookup, "TILE_ROWS", (16, 16))
    monkeypatch.setattr(lookup, "TILE_QUERIES", 3)
    r = random.Random(k)
    base = [(f"v{i:03d}", [r.gauss(0, 1) for _ in range(5)]) for i in range(60)]
    base += [(f"w{i}", base[3][1]) for i in range(20)] + [("z", [0.0] * 5), ("n", None), ("m", [1.0, None, 2.0, 0.0, 1.0]),
                                                         ("s", [1.0, 2.0]), (None, base[0][1]), base[5], base[5]]
    asked = [base[i] for i in (3, 4, 5, 70, 80, 81, 83)] + [(None, base[1][1])]
    schema = "id string, v array<double>"
    got = [tuple(x) for x in lookup.knn_exact(spark.createDataFrame(asked, schema), spark.createDataFrame(base, schema),
                                              k, "id", "id", "v").collect()]

    def unit(v):
        if not v or None in v or not any(v):
            return None
        norm = sum(x * x for x in v) ** 0.5
        return [x / norm for x in v]
    want = []
    for qid, qv in asked[:-1]:
        met = []
        for bid, bv in base:
            if bid is not None and bid != qid:
                a, b = unit(qv), unit(bv)
                s = sum(x * y for x, y in zip(a, b)) if a and b and len(a) == len(b) else None
                met.append((s is None, -round(s, 6) if s is not None else 0.0, bid))
        want += [(qid, i, bid, None if none else -s) for i, (none, s, bid) in enumerate(sorted(met)[:k], 1)]
    assert sorted(x[:3] for x in got) == sorted(x[:3] for x in want)
    values = {x[:3]: x[3] for x in want}
    assert all((s is None) == (values[q, i, b] is None) and (s is None or abs(s - values[q, i, b]) < 2e-6)
               for q, i, b, s in got)


def test_the_norm_is_computed_once_for_a_vector(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0]), (3, None)], "id int, v array<double>")
    out = lookup.with_unit_vectors(df, "v")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("SQRT(aggregate(") == 1
    assert [r._u for r in out.orderBy("id").collect()] == [[0.6, 0.8], None, None]
