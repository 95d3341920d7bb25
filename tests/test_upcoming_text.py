"""Columns made of a team's fixtures, once per team."""

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tallyframe.operators import fixtures as fx
from tallyframe.plans.catalog import QUERIES
from tallyframe.session import long_values

_WRITER = ("parquet.page.size.row.check.min", "parquet.block.size.row.check.min", "parquet.dictionary.page.size",
           "parquet.column.statistics.enabled#upcoming")


def test_columns_of_the_fixtures_are_made_per_team(spark):
    players = spark.createDataFrame([(i, i % 3 if i % 7 else None) for i in range(1, 60)], "player_id long, team_id int")
    teams = spark.createDataFrame([(0, "A", "a"), (1, "B", "b")], "team_id int, team_name string, team_short string")
    games = spark.createDataFrame(
        [(10, 2, 0, 1, 2, None, None), (11, 1, 1, 0, 4, 5, None), (12, 9, 0, 1, 1, 1, None), (13, None, 0, 1, 1, 1, None)],
        "fixture_id long, event int, team_h int, team_a int, team_h_difficulty int, team_a_difficulty int, "
        "kickoff_time timestamp")
    plain = fx.upcoming_fixtures(players, games, teams, 0, 5)

    def shown(c):
        return {"n": F.size(c), "text": F.array_join(F.transform(c, lambda x: x["fixture_id"].cast("string")), ";")}
    out = fx.upcoming_fixtures(players, games, teams, 0, 5, shown)
    want = sorted((r.player_id, len(r.upcoming), ";".join(str(x.fixture_id) for x in r.upcoming)) for r in plain.collect())
    got = sorted((r.player_id, r.n, r.text) for r in out.collect())
    assert got == want and len(got) == 59
    assert {g[1:] for g in got} == {(2, "11;10"), (0, "")}
    # made before the join with the players: the array itself does not reach them
    above = out._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert "transform(upcoming" not in above


def test_a_text_of_a_megabyte_is_written_once_not_for_each_player(spark, tmp_path):
    """the writer held 100 rows of a team's whole text in a page."""
    n, d = 140_000, str(tmp_path)
    ts = "timestamp_ntz'2000-11-05 00:00:00'"
    spark.range(64).selectExpr("id as c_custkey", "concat('C#', id) as c_name", "cast(id % 2 as int) as c_nationkey",
                               "0.0d as c_acctbal", "'AUTOMOBILE' as c_mktsegment").write.parquet(f"{d}/customer.parquet")
    spark.range(2).selectExpr("cast(id as int) as n_nationkey", "concat('A LAND OF A LONG NAME ', id) as n_name",
                              "0 as n_regionkey").write.parquet(f"{d}/nation.parquet")
    spark.range(n).selectExpr("id as o_orderkey", "id % 64 as o_custkey", "'F' as o_orderstatus", "1.0d as o_totalprice",
                              f"{ts} as o_orderdate", "'1-URGENT' as o_orderpriority").write.parquet(f"{d}/orders.parquet")
    had = {k: spark.conf.get(k, None) for k in _WRITER}
    try:
        QUERIES["upcoming_fixtures"](spark, d).coalesce(1).write.parquet(f"{d}/out")
    finally:
        for k, v in had.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    file = pq.ParquetFile(next((tmp_path / "out").glob("*.parquet")))
    rows = file.read().to_pylist()
    texts = {r["team_id"]: r["upcoming"] for r in rows}
    assert len(rows) == 64 and len({r["player_id"] for r in rows}) == 64
    assert all(r["upcoming"] == texts[r["team_id"]] and r["upcoming"].count(";") + 1 == r["n_fixtures"] for r in rows)
    # home: every order that is scheduled and has another team away; away: id % 26
    games = [i for i in range(n) if i % 29 and i % 2 != i % 26]
    for team in (0, 1):
        want = [i for i in games if i % 2 == team or i % 26 == team]
        want.sort(key=lambda i: (i % 23 != 0, i))  # no kickoff first, then the id
        assert [int(x.split("|")[1]) for x in texts[team].split(";")] == want
        assert len(texts[team]) > 1 << 20
    at = file.schema_arrow.names.index("upcoming")
    groups = [file.metadata.row_group(i).column(at) for i in range(file.metadata.num_row_groups)]
    assert sum(g.total_uncompressed_size for g in groups) < 2 * sum(map(len, texts.values()))


def test_what_the_session_has_set_for_the_writer_stays(spark):
    key = "parquet.dictionary.page.size"
    had = {k: spark.conf.get(k, None) for k in _WRITER}
    try:
        spark.conf.set(key, "4096")
        long_values(spark, "upcoming")
        assert spark.conf.get(key) == "4096" and spark.conf.get("parquet.page.size.row.check.min") == "16"
    finally:
        for k, v in had.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
