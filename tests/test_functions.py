"""Column helpers: rounding, clip, text, dates."""

from datetime import date

from pyspark.sql import functions as F

from tallyframe.functions.dates import month_key, season_label
from tallyframe.functions.numeric import clip, js_round, round_half_even
from tallyframe.functions.text import truncate_sentences


def test_half_even_and_js_round_and_null_safe_clip(spark):
    df = spark.createDataFrame([(2.25,), (2.35,), (-0.5,), (None,)], "x double")
    r = df.select(round_half_even("x", 1).alias("a"), js_round("x").alias("b"),
                  clip("x", 0.0, 2.3).alias("c")).collect()
    assert [x.a for x in r] == [2.2, 2.4, -0.5, None]
    assert [x.b for x in r] == [2, 2, 0, None]
    assert [x.c for x in r] == [2.25, 2.3, 0.0, None]


def test_truncate_sentences(spark):
    df = spark.createDataFrame([("One. Two! Three? Four.",), ("no terminator " * 20,), (None,)], "t string")
    got = [r.s for r in df.select(truncate_sentences("t", 2).alias("s")).collect()]
    assert got[0] == "One.  Two!"  # sentences keep their leading space, as in the product
    assert len(got[1]) == 120 and got[2] is None


def test_season_label_august_cutover_and_month_key(spark):
    df = spark.createDataFrame([(date(2025, 7, 31),), (date(2025, 8, 1),), (date(2099, 12, 1),)], "d date")
    r = df.select(season_label("d").alias("s"), month_key("d").alias("m")).collect()
    assert [x.s for x in r] == ["2024-25", "2025-26", "2099-00"]
    assert [x.m for x in r] == ["2025-07", "2025-08", "2099-12"]


def test_cluster_sizing_scales_partitions_with_input():
    from tallyframe.session import cluster_sizing
    small = cluster_sizing(1 << 30, executors=10, cores_per_executor=4)
    big = cluster_sizing(100 << 40, executors=1000, cores_per_executor=8)
    assert int(small["spark.sql.shuffle.partitions"]) == 80          # two waves of 40 slots
    assert int(big["spark.sql.shuffle.partitions"]) == (100 << 40) // (256 << 20)
    assert big["spark.sql.adaptive.skewJoin.enabled"] == "true"
