"""Cleaning and data-quality operators (cases from the product's tests)."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.operators import clean, quality
from tests.conftest import rows


def test_dedupe_keep_last_and_first(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 3, "c"), (1, 3, "d")],
                               "id int, pos int, v string")
    assert rows(clean.latest_per_key(df, ["id"], ["pos"]), "id", "v") == [(1, "d"), (2, "c")]
    assert rows(clean.first_per_key(df, ["id"], ["pos"]), "id", "v") == [(1, "a"), (2, "c")]
    assert rows(clean.dedupe_window(df, ["id"], ["pos"], "last"), "id", "v") == [(1, "d"), (2, "c")]


def test_latest_snapshot_per_scope(spark):
    df = spark.createDataFrame([("s1", "2024-01-01", 1), ("s1", "2024-01-02", 2), ("s1", "2024-01-02", 3),
                                ("s2", "2023-05-01", 4)], "season string, snap string, id int")
    assert rows(clean.latest_snapshot(df, ["season"], "snap"), "id") == [(2,), (3,), (4,)]


def test_flatten_missing_key_and_coerce_bad_values(spark):
    df = spark.createDataFrame([(1, '{"k": "5", "id": 7}'), (2, '{"k": "abc"}'), (3, '{}')],
                               "event_id int, props string")
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("id", T.LongType())])
    flat = clean.flatten_json(df, "props", schema, keep_cols=("event_id",), meta={"season": "s"})
    c = clean.coerce(flat, {"k": "BIGINT"})
    assert rows(c, "event_id", "k", "id", "season") == [(1, 5, 7, "s"), (2, None, None, "s"),
                                                        (3, None, None, "s")]


def test_schema_drift_reports_unexpected_keys(spark):
    df = spark.createDataFrame([('{"id": 1, "new": 2}',), ('{"id": 1, "code": 3, "new": 1}',)], "props string")
    got = rows(clean.schema_drift(df, "props", ["id"], ["code"]))
    assert got == [("new", 2)]


def test_normalise_name_accents_hyphen_apostrophe(spark):
    df = spark.createDataFrame([("Estupiñán",), ("Ødegaard",), ("Jean-Philippe",), ("O'Brien ",)], "n string")
    got = [r.k for r in df.select(clean.normalise_name("n").alias("k")).collect()]
    assert got == ["estupinan", "degaard", "jean philippe", "obrien"]


def test_fallback_join_full_then_short_first_duplicate_wins(spark):
    left = spark.createDataFrame([(1, "Bukayo Saka", "Saka"), (2, "Martin Odegaard", "Odegaard"),
                                  (3, "Nobody Here", "Nobody")], "player_id int, full_name string, web_name string")
    right = spark.createDataFrame([("BUKAYO-SAKA", 0.5, 1), ("Odegaard", 0.3, 2), ("Odegaard", 0.9, 3)],
                                  "player_name string, xg double, src_pos int")
    j = clean.fallback_name_join(left, right, "full_name", "web_name", "player_name", "src_pos", ["xg"])
    assert rows(j, "player_id", "xg", "matched_on") == [(1, 0.5, "full"), (2, 0.3, "short"), (3, None, None)]


PLAYERS = [(1, "A", 1, 1, 100, 900), (2, None, 1, 2, 999, 900), (2, "C", 2, 99, 50, 900)]


def test_record_checks_split_and_warnings(spark):
    df = spark.createDataFrame(PLAYERS, "id int, web_name string, team int, element_type int, "
                                        "total_points int, minutes int")
    exp = quality.Expectations(not_null=("id", "web_name", "team"),
                               value_ranges={"total_points": {"min": -10, "max": 300},
                                             "element_type": {"allowed": [1, 2, 3, 4]}})
    valid, failed = quality.quarantine_split(df, exp, "id")
    assert valid.count() == 2 and failed.count() == 1
    assert failed.collect()[0].errors == ["null value in required column 'web_name'"]
    w = rows(quality.range_warnings(df, exp, "id"), "warning")
    assert ("Record 2: total_points=999 above max 300",) in w
    assert ("Record 2: element_type=99 not in allowed values [1, 2, 3, 4]",) in w
    u = quality.uniqueness_report(df, ["id"], "players").collect()[0]
    assert u.duplicated_keys == 1 and u.surplus_rows == 1
    assert u.message == "Duplicate values in 'id': [2]"


def test_uniqueness_message_caps_sample(spark):
    df = spark.range(0, 30).select((F.col("id") % 12).alias("k"))
    u = quality.uniqueness_report(df, ["k"], "d").collect()[0]
    assert u.surplus_rows == 18 and u.message.endswith("(and 8 more)")


def test_validation_status_partial(spark):
    ok = spark.createDataFrame([(1, "a")], "id int, web_name string")
    bad = spark.createDataFrame([(1, None), (2, "b")], "id int, web_name string")
    exp = quality.Expectations(not_null=("web_name",))
    s = quality.validation_status({"a": (ok, exp, "id"), "b": (bad, exp, "id")}).collect()[0]
    assert (s.status, s.records_valid, s.records_invalid) == ("partial", 2, 1)


def test_contract_report_counts_rule_violations(spark):
    df = spark.createDataFrame([("GKP", 50.0), ("XXX", 101.0), (None, 10.0)], "position string, composite_score double")
    c = [("position", "regex", r"^(GKP|DEF|MID|FWD)$"), ("composite_score", "range", (0.0, 100.0)),
         ("position", "not_null", None)]
    assert rows(quality.contract_report(df, c)) == [("composite_score", "range", 1), ("position", "not_null", 1),
                                                    ("position", "regex", 1)]


def test_folded_mode_matches_accented_names_strict_mode_misses(spark):
    left = spark.createDataFrame([(1, "Martin Ødegaard", "Ødegaard"), (2, "Łukasz Fabiański", "Fabiański")],
                                 "player_id int, full_name string, web_name string")
    right = spark.createDataFrame([("Martin Odegaard", 0.4, 1), ("lukasz fabianski", 0.0, 2)],
                                  "player_name string, xg double, src_pos int")
    strict = clean.fallback_name_join(left, right, "full_name", "web_name", "player_name", "src_pos", ["xg"])
    folded = clean.fallback_name_join(left, right, "full_name", "web_name", "player_name", "src_pos", ["xg"],
                                      norm=clean.normalise_name_folded)
    assert rows(strict, "player_id", "matched_on") == [(1, None), (2, None)]
    assert rows(folded, "player_id", "xg", "matched_on") == [(1, 0.4, "full"), (2, 0.0, "full")]
