"""History views of one season, and listing of partitions."""

import pytest
from pyspark.errors import AnalysisException

from tallyframe.operators import insights as ins
from tallyframe.sources import sinks

ROWS = [("2024-25", 1, 1, 10.0, 1), ("2024-25", 1, 2, 90.0, 1), ("2025-26", 1, 1, 50.0, 2), ("2025-26", 1, 2, 55.0, 2),
        ("2025-26", 2, 1, 60.0, 1), ("2025-26", 2, 2, 58.0, 1)]


@pytest.fixture
def history(spark):
    return spark.createDataFrame(
        ROWS, "season string, player_id int, gameweek int, composite_score double, composite_rank int")


def test_seasons_do_not_mix(history):
    deltas = {(r.kind, r.player_id): r.delta for r in ins.movers(history, 1, 2, 1).collect()}
    assert deltas == {("riser", 1): 5.0, ("faller", 2): -2.0}
    before = ins.movers(history, 1, 2, 1, season="2024-25").collect()
    assert {(r.player_id, r.delta) for r in before} == {(1, 80.0)}
    matrix = {r.player_id: (r["1"], r["2"]) for r in ins.momentum_matrix(history, 2, [1, 2]).collect()}
    assert matrix == {1: (50.0, 55.0), 2: (60.0, 58.0)}
    series = ins.score_series(history, history.select("player_id").distinct(), 1, 2).collect()
    assert sorted((r.player_id, r.gameweek, r.composite_score) for r in series) == [
        (1, 1, 50.0), (1, 2, 55.0), (2, 1, 60.0), (2, 2, 58.0)]


def test_partition_listing_hides_no_failure(spark, tmp_path):
    assert sinks.existing_partitions(spark, str(tmp_path / "none"), ["season"]).count() == 0
    sinks.write_partitioned(spark.createDataFrame([("a", 1)], "season string, x int"), str(tmp_path / "t"), ["season"])
    with pytest.raises(AnalysisException):
        sinks.existing_partitions(spark, str(tmp_path / "t"), ["missing"]).count()
