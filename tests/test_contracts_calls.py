"""Nested contracts, injected batch calls, run scores, published dates."""

import datetime
import json

from pyspark.sql import functions as F

from tallyframe.functions.dates import published_at
from tallyframe.operators import calls, contracts, evals
from tallyframe.operators.contracts import Rule

NESTED = Rule("object", closed=True, fields={
    "teams": Rule("list", min_length=1, items=Rule("object", closed=True, fields={
        "name": Rule("string", pattern="^[A-Z]"),
        "weeks": Rule("list", items=Rule("list", items=Rule("integer", minimum=1, maximum=38)))})),
    "note": Rule("string", required=False, nullable=True)})


def broken(spark, docs, rule=NESTED):
    df = spark.createDataFrame([(i, d if d is None or isinstance(d, str) else json.dumps(d))
                                for i, d in enumerate(docs)], "i int, j string")
    return [r.broken for r in contracts.checked_json(df, "j", rule).orderBy("i").collect()]


def test_rules_at_every_depth(spark):
    team = {"name": "Ax", "weeks": [[1, 2], []]}
    assert broken(spark, [
        {"teams": [team]}, {"teams": [team], "note": None}, {"teams": []}, {"teams": [{**team, "x": 1}], "y": 2},
        {"teams": [team, {"name": "b", "weeks": [[0, 39, 1.0], "w", None]}]}, {"teams": [team, 5], "note": 3},
        {"teams": [{"name": "A"}]}, {"teams": [{"name": "A", "weeks": [["1", True, 1.5]]}]}, [1], "no json", None, {},
    ]) == [
        [], [], ["$.teams:min_length"], ["$:unknown_key", "$.teams[]:unknown_key"],
        ["$.teams[].name:pattern", "$.teams[].weeks[]:null", "$.teams[].weeks[]:type",
         "$.teams[].weeks[][]:minimum", "$.teams[].weeks[][]:maximum"],
        ["$.teams[]:type", "$.note:type"], ["$.teams[].weeks:missing"], ["$.teams[].weeks[][]:type"], ["$:type"],
        ["$:document"], ["$:document"], ["$.teams:missing"]]


def test_quotes_in_rules(spark):
    rule = Rule("object", fields={"it's": Rule("string", allowed=("a'b", "c\\d"))})
    assert broken(spark, [{"it's": "a'b"}, {"it's": "c\\d"}, {"it's": "x"}], rule) == [[], [], ["$.it's:allowed"]]


def test_counts_of_rows(spark):
    df = spark.createDataFrame([(1, ["a", None, None]), (2, None), (None, ["b"]), (3, [None])],
                               "n int, xs array<string>")
    rule = Rule("object", fields={"n": Rule("integer", maximum=2), "xs": Rule("list", items=Rule("string")),
                                  "gone": Rule("string")})
    got = {(r.path, r.rule): (r["values"], r.documents) for r in contracts.contract_counts(df, rule, "d").collect()}
    assert got == {("$.n", "null"): (1, 1), ("$.n", "maximum"): (1, 1), ("$.xs", "null"): (1, 1),
                   ("$.xs[]", "null"): (3, 2), ("$.gone", "missing"): (4, 4)}
    assert contracts.contract_counts(df.limit(0), rule, "d").count() == 0


def test_batches_run_on_across_arrow_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        df = spark.range(23).repartition(1).withColumnRenamed("id", "k")
        sizes = calls.call_in_batches(df, lambda rows: [len(rows)] * len(rows), ["k"], ["k"], 10).collect()
        assert sorted(int(r.answer) for r in sizes) == [3] * 3 + [10] * 20 and not any(r.alone for r in sizes)

        def fails(rows):
            if any(r["k"] in (5, 6) for r in rows):
                raise KeyError("five")
            return [{"k": r["k"]} for r in rows] if all(r["k"] != 22 for r in rows) else []
        got = {r.k: (r.answer, r.error, r.alone) for r in calls.call_in_batches(df, fails, ["k"], ["k"], 10).collect()}
        assert {k for k, v in got.items() if v[1]} == {5, 6, 22}
        assert got[5][1] == "KeyError: 'five'" and got[22][1] == "ValueError: 1 items, 0 answers"
        assert json.loads(got[7][0]) == {"k": 7} and len(got) == 23
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert calls.call_in_batches(df.limit(0), fails, ["k"], ["k"], 10).count() == 0


def test_keys_and_scores_of_calls(spark):
    rows = [("r", 1, "find", '{"b":2,"a":{"z":[1,true],"y":null}}', "bad"),
            ("r", 2, "find", '{"a":{"y":null,"z":[1,true]},"b":2}', None),
            ("r", 3, "find", '{"b":3}', "bad"), ("r", 4, "list", None, None), ("r", 5, "list", "{}", None),
            ("s", 1, "find", json.dumps({"q": "x" * 90}), "bad")]
    df = spark.createDataFrame(rows, "case_id string, seq int, name string, args string, error string")
    keys = [r[0] for r in df.orderBy("case_id", "seq").select(
        evals.result_key(F.col("name"), F.try_parse_json("args"))).collect()]
    assert keys[:5] == ["find(a={y=None,z=[1,True]},b=2)"] * 2 + ["find(b=3)", "list", "list"]
    assert keys[5].startswith("find#") and len(keys[5]) <= 9
    runs = spark.createDataFrame([("r", True, None, 2), ("s", True, "stopped", 0), ("t", False, None, None)],
                                 "case_id string, answered boolean, error string, iterations int")
    got = {r.case_id: tuple(r)[1:] for r in evals.run_scores(df, runs).collect()}
    assert got == {"r": (5, 3, 2, 1.0, 2.0, 0.6667), "s": (1, 1, 0, 0.0, 0.0, 0.0), "t": (0, 0, 0, 0.0, 0.0, 1.0)}


def test_published_dates(spark):
    day = datetime.date
    want = {"Mon, 01 Jan 2024 23:30:00 GMT": day(2024, 1, 1), "Mon, 1 Jan 2024 23:30:00 -0500": day(2024, 1, 2),
            "Tue,  2 Jan 2024 01:30:00 +0530": day(2024, 1, 1), "01 Jan 24 23:30 PST": day(2024, 1, 2),
            "2024-01-01T23:30:00-05:00": day(2024, 1, 2), "2024-01-01T23:30:00.123456Z": day(2024, 1, 1),
            "2024-01-01 10:00:00": day(2024, 1, 1), "2024-02-29": day(2024, 2, 29), "29 Feb 2024": day(2024, 2, 29),
            "2023-02-29": None, "soon": None, "": None, "Mon, 01 Jan 2024 23:30:00 XYZ": None}
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            df = spark.createDataFrame([(x,) for x in want], "t string").select("t", published_at(F.col("t")).alias("p"))
            assert {r.t: r.p.date for r in df.collect()} == want
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_a_node_is_taken_from_the_document_once(spark):
    df = spark.range(2).select(F.to_variant_object(F.struct("id")).alias("_document"))
    out, rules = contracts.broken_rules(df, "_document", contracts.PICK_ROW)
    made = [text for layer in contracts_layers(contracts.PICK_ROW) for _, text in layer]
    assert sum("price" in t for t in made) == 1 and len(out.columns) == 1 + len(made)
    assert len(rules) > 40 and not any("schema_of_variant" in str(n) for _, _, n in rules)  # kinds are told once a node


def contracts_layers(rule):
    nodes = contracts._Nodes("_document")
    contracts._walk(rule, "$", "filter(array(_document), x -> x is not null)", nodes)
    return nodes.layers
