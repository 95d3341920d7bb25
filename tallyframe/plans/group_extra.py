"""Catalogue entries: raw document scan (S1), column presence (Q1 Q14),
eval case filter (O10) and the gated snapshot export (S15)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.operators import evals, quality
from tallyframe.plans.catalog import query
from tallyframe.plans.context import Context
from tallyframe.plans.oracle import oracle
from tallyframe.session import scratch_path
from tallyframe.sources import sinks

DOC_SIZE = 500  # players per landed raw document (bounded documents, many files)

RAW_SCHEMA = T.StructType([
    T.StructField("doc", T.LongType()),
    T.StructField("elements", T.ArrayType(T.StructType([
        T.StructField("id", T.LongType()), T.StructField("web_name", T.StringType()),
        T.StructField("team", T.LongType()), T.StructField("element_type", T.LongType()),
        T.StructField("now_cost", T.LongType()), T.StructField("form", T.StringType())]))),
])


def land_raw_documents(c: Context, path: str) -> None:
    """Raw bootstrap-like documents: one JSON document per id range of at
    most DOC_SIZE players (numbers with decimals as strings, plus a key the
    reader does not expect)."""
    p = c.players.select(F.floor(F.col("player_id") / DOC_SIZE).alias("doc"), "src_pos",
                         F.struct(F.col("player_id").alias("id"), "web_name", F.col("team_id").alias("team"),
                                  "element_type", "now_cost", F.col("form").cast("string").alias("form"),
                                  F.lit(0).alias("squad_number")).alias("e"))
    docs = p.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("src_pos", "e"))).alias("_l"))
    docs.select("doc", F.col("_l").getField("e").alias("elements")).write.mode("overwrite").json(path)


@query("raw_snapshot_scan")
def _(c: Context):
    """Landed JSON documents read with a DECLARED schema (no
    inference; unexpected keys ignored), elements posexploded with their
    position, decimal strings coerced."""
    path = scratch_path(c.spark, "raw")
    land_raw_documents(c, path)
    d = c.spark.read.schema(RAW_SCHEMA).json(path)
    e = d.select("doc", F.posexplode("elements").alias("pos", "el"))
    return e.select("doc", F.col("pos").cast("int").alias("pos"), F.col("el.id").alias("id"),
                    F.col("el.web_name").alias("web_name"), F.col("el.team").alias("team"),
                    F.col("el.element_type").alias("element_type"), F.col("el.now_cost").alias("now_cost"),
                    F.expr("try_cast(el.form AS DOUBLE)").alias("form"))


oracle("raw_snapshot_scan", f"""
SELECT player_id // {DOC_SIZE} AS doc,
       CAST(row_number() OVER (PARTITION BY player_id // {DOC_SIZE} ORDER BY src_pos) - 1 AS INTEGER) AS pos,
       player_id AS id, web_name, CAST(team_id AS BIGINT) AS team, CAST(element_type AS BIGINT) AS element_type,
       now_cost, form
FROM v_players""", "v_players")

REQUIRED_KEYS = ["k", "id"]


@query("column_presence")
def _(c: Context):
    """Q1 Q14: (a) schema gate -- required columns absent from a frame's
    schema (metadata only, no data read); (b) row level -- records whose
    raw JSON lacks a required key (one map parse, one aggregate)."""
    raw_fixture_cols = c.fixtures.columns
    missing = [col for col in quality.FIXTURE_SCHEMA.column_presence if col not in raw_fixture_cols]
    schema_rows = c.spark.createDataFrame([("schema", "fixtures_raw", m, 1) for m in missing],
                                          "level string, dataset string, key string, missing bigint")
    keys = F.map_keys(F.from_json("props", "map<string,string>"))
    ev = c.t.events.select(keys.alias("_k"))
    aggs = [F.count_if(~F.array_contains("_k", k)).alias(k) for k in REQUIRED_KEYS]
    row = ev.agg(*aggs).select(F.inline(F.array(*[
        F.struct(F.lit("record").alias("level"), F.lit("events").alias("dataset"), F.lit(k).alias("key"),
                 F.col(k).alias("missing")) for k in REQUIRED_KEYS])))
    return schema_rows.unionByName(row)


def _column_presence_sql():
    parts = [f"SELECT 'schema' AS level, 'fixtures_raw' AS dataset, '{m}' AS key, CAST(1 AS BIGINT) AS missing"
             for m in quality.FIXTURE_SCHEMA.column_presence
             if m not in ["fixture_id", "event", "team_h", "team_a", "team_h_difficulty", "team_a_difficulty",
                          "kickoff_time"]]
    parts += [f"SELECT 'record', 'events', '{k}', CAST(count_if(NOT list_contains(json_keys(props), '{k}')) "
              f"AS BIGINT) FROM events" for k in REQUIRED_KEYS]
    return "\nUNION ALL\n".join(parts)


oracle("column_presence", _column_presence_sql())

CASE_CATEGORIES = ["cat1", "cat3"]
MAX_CASES = 10


@query("eval_case_filter")
def _(c: Context):
    """Case selection by categories, then the max-cases cap (the cap is
    the feature); an empty selection is an error."""
    from tallyframe.plans.group_ledger import cases_runs
    cases, _runs = cases_runs(c)
    return evals.filter_cases(cases, categories=CASE_CATEGORIES, max_cases=MAX_CASES).select("case_id", "category")


oracle("eval_case_filter", f"""
SELECT conv_id AS case_id, 'cat' || CAST(conv_id % 11 AS VARCHAR) AS category
FROM (SELECT DISTINCT conv_id FROM conversations) c
WHERE 'cat' || CAST(conv_id % 11 AS VARCHAR) IN ({", ".join(f"'{x}'" for x in CASE_CATEGORIES)})
ORDER BY conv_id LIMIT {MAX_CASES}""")

# Ids of the explicit selection; those above the table's are not found.
CASE_IDS = [3, 5, 8, 12, 999_999_999]


@query("eval_case_ids")
def _(c: Context):
    """Explicit ids win over categories."""
    from tallyframe.plans.group_ledger import cases_runs
    cases, _runs = cases_runs(c)
    return evals.filter_cases(cases, ids=CASE_IDS, categories=CASE_CATEGORIES, max_cases=MAX_CASES).select(
        "case_id", "category")


oracle("eval_case_ids", f"""
SELECT DISTINCT conv_id AS case_id, 'cat' || CAST(conv_id % 11 AS VARCHAR) AS category FROM conversations
WHERE conv_id IN ({", ".join(map(str, CASE_IDS))})""")

# Fixed values of the export gate: columns the snapshot must carry and
# names that must be present.
EXPORT_COLUMNS = ["player_id", "web_name", "team_name", "position", "price", "composite_score", "form_trend"]
PINNED = ["000000001", "000000002", "000000011"]


@query("snapshot_export")
def _(c: Context):
    """Gates (rows > 0, required columns, pinned names present) in one
    aggregate; the snapshot is written only when all pass, then re-read."""
    d = c.dashboard_shared
    cols_ok = all(x in d.columns for x in EXPORT_COLUMNS)
    g = d.agg(F.count(F.lit(1)).alias("rows"),
              *[F.max(F.lower("web_name").contains(p).cast("int")).alias(f"p{i}") for i, p in enumerate(PINNED)])
    gate = g.select((F.col("rows") > 0).alias("rows_ok"), F.lit(cols_ok).alias("columns_ok"),
                    F.coalesce(F.least(*[F.col(f"p{i}") for i in range(len(PINNED))]) == 1, F.lit(False))
                    .alias("pinned_ok")).collect()[0]  # one row of three flags
    written = 0
    if gate.rows_ok and gate.columns_ok and gate.pinned_ok:
        path = scratch_path(c.spark, "snapshot")
        sinks.write_partitioned(sinks.stamp_version(d.select(*EXPORT_COLUMNS, "season", "gameweek"), "v1"),
                                path, ["season", "gameweek"])
        written = c.spark.read.parquet(path)
        return written.agg(F.count(F.lit(1)).alias("rows_written"),
                           F.bround(F.sum(F.col("composite_score").cast("decimal(18,1)")).cast("double"), 1)
                           .alias("score_sum")).select(
            F.lit(True).alias("rows_ok"), F.lit(True).alias("columns_ok"), F.lit(True).alias("pinned_ok"),
            "rows_written", "score_sum")
    return c.spark.createDataFrame([(bool(gate.rows_ok), bool(gate.columns_ok), bool(gate.pinned_ok), 0, None)],
                                   "rows_ok boolean, columns_ok boolean, pinned_ok boolean, rows_written bigint, "
                                   "score_sum double")


_PIN_SQL = " AND ".join(f"bool_or(strpos(lower(web_name), '{p}') > 0)" for p in PINNED)
oracle("snapshot_export", f"""
SELECT rows_ok, columns_ok, pinned_ok,
       CASE WHEN rows_ok AND columns_ok AND pinned_ok THEN n ELSE 0 END AS rows_written,
       CASE WHEN rows_ok AND columns_ok AND pinned_ok THEN s END AS score_sum FROM (
  SELECT count(*) > 0 AS rows_ok, true AS columns_ok, coalesce({_PIN_SQL}, false) AS pinned_ok,
         CAST(count(*) AS BIGINT) AS n,
         round_even(CAST(sum(CAST(composite_score AS DECIMAL(18,1))) AS DOUBLE), 1) AS s
  FROM v_dashboard) x""", "v_dashboard")
