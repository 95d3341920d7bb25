"""Catalogue entries: history upsert and publish gate (U1 S10 J14 O5),
sinks (S7 S8 S9 S11 S12 S13) and streaming (T1-T7).

Queries here WRITE to a fresh folder under the shared ``spark.checkpoint.dir``
and return what was read back, so the round trip itself is checked.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.operators import curate, enrich, quality
from tallyframe.plans.catalog import query
from tallyframe.plans.context import Context
from tallyframe.plans.oracle import oracle
from tallyframe.plans.oracle_views import SEASON
from tallyframe.session import scratch_path
from tallyframe.sources import sinks, standins
from tallyframe.streaming import jobs

_HIST_COLS = ["season", "gameweek", "player_id", "composite_score", "price", "ownership_pct", "sentiment_score",
              "composite_rank"]
LAST_GW = 30


def _history_cols(c: Context):
    return standins.history(c.t).select(*_HIST_COLS)


def _dashboard_as_history(c: Context):
    d = c.dashboard
    return d.select(F.lit(SEASON).alias("season"), F.lit(LAST_GW).cast("int").alias("gameweek"), "player_id",
                    "composite_score", "price", "ownership_pct", "sentiment_score", "composite_rank")


@query("player_history_upsert")
def _(c: Context):
    """History stored partitioned by (season, gameweek); the new
    gameweek is written with dynamic partition overwrite (only that
    partition is replaced), then read back."""
    path = scratch_path(c.spark, "history")
    sinks.write_partitioned(_history_cols(c), path, ["season", "gameweek"])
    sinks.write_partitioned(_dashboard_as_history(c), path, ["season", "gameweek"])
    h = sinks.read_partitioned(c.spark, path)
    return h.select(*_HIST_COLS)


oracle("player_history_upsert", f"""
SELECT season, gameweek, player_id, composite_score, price, ownership_pct, sentiment_score, composite_rank
FROM v_history WHERE NOT (season = '{SEASON}' AND gameweek = {LAST_GW})
UNION ALL
SELECT '{SEASON}', CAST({LAST_GW} AS INTEGER), player_id, composite_score, price, ownership_pct, sentiment_score,
       composite_rank FROM v_dashboard""", "v_history", "v_dashboard")


@query("public_gate")
def _(c: Context):
    """Publish 'latest' only for a (season, gameweek) not older than
    the newest in history (compared as a pair, unlike the product)."""
    h = _history_cols(c)
    cands = c.spark.createDataFrame([(SEASON, LAST_GW - 1), (SEASON, LAST_GW), ("2026-27", 1)],
                                    "season string, gameweek int")
    return curate.latest_gate_many(h, cands)


oracle("public_gate", f"""
SELECT c.season, c.gameweek, m.max_season, m.max_gameweek,
       (c.season, c.gameweek) >= (m.max_season, m.max_gameweek) AS publish
FROM (VALUES ('{SEASON}', {LAST_GW - 1}), ('{SEASON}', {LAST_GW}), ('2026-27', 1)) c(season, gameweek)
CROSS JOIN (SELECT arg_max(season, row(season, gameweek)) AS max_season,
                   arg_max(gameweek, row(season, gameweek)) AS max_gameweek FROM v_history) m""", "v_history")


@query("sink_roundtrip")
def _(c: Context):
    """Dashboard -> zstd Parquet partitioned by (season,
    gameweek) with a schema-version stamp; briefing stats -> JSON document;
    failed fixture records -> DLQ; everything read back and summarised."""
    root = scratch_path(c.spark, "sinks")
    d = sinks.stamp_version(c.dashboard.select("player_id", "composite_score", "season", "gameweek"),
                            sinks.SCHEMA_VERSION_CURATED)
    sinks.write_partitioned(d, f"{root}/dashboard", ["season", "gameweek"])
    dash, picks = c.dashboard_shared, c.picks_shared
    doc = curate.briefing_document(curate.briefing_lists(dash, picks, c.fdr_shared, c.teams),
                                   curate.briefing_stats(dash, picks), curate.theme_topk(dash),
                                   SEASON, LAST_GW, standins.ADVICE_GW)
    sinks.write_document(doc, f"{root}/public/briefing")
    fx = c.fixtures.select(F.col("fixture_id").alias("id"), F.col("event").alias("gameweek"),
                           F.col("team_h").alias("home_team"), F.col("team_a").alias("away_team"))
    _ok, failed = quality.quarantine_split(fx, quality.FIXTURE_SCHEMA, "id")
    sinks.write_dlq(failed.select("*", F.lit("fixtures").alias("dataset")), f"{root}/dlq", ["dataset"])
    back = sinks.read_partitioned(c.spark, f"{root}/dashboard")
    parts = sinks.existing_partitions(c.spark, f"{root}/dashboard", ["season", "gameweek"])
    doc_back = c.spark.read.json(f"{root}/public/briefing")
    dlq = c.spark.read.json(f"{root}/dlq")
    a = back.agg(F.count(F.lit(1)).alias("dashboard_rows"), F.max("schema_version").alias("schema_version"),
                 F.bround(F.sum(F.col("composite_score").cast("decimal(18,1)")).cast("double"), 1).alias("score_sum"))
    return (a.crossJoin(parts.agg(F.count(F.lit(1)).alias("partitions")))
             .crossJoin(doc_back.select(F.col("summary_stats.buy_count").cast("bigint").alias("doc_buy_count"),
                                   sum(F.size(x) for x in curate.BRIEFING_LISTS).cast("bigint")
                                   .alias("doc_list_items"),
                                   F.size("trending_themes").cast("bigint").alias("doc_themes")))
             .crossJoin(dlq.agg(F.count(F.lit(1)).alias("dlq_rows"))))


oracle("sink_roundtrip", f"""
SELECT CAST(count(*) AS BIGINT) AS dashboard_rows, '{sinks.SCHEMA_VERSION_CURATED}' AS schema_version,
       round_even(CAST(sum(CAST(composite_score AS DECIMAL(18,1))) AS DOUBLE), 1) AS score_sum,
       CAST(1 AS BIGINT) AS partitions,
       (SELECT CAST(count_if(recommendation = 'buy') AS BIGINT) FROM v_picks) AS doc_buy_count,
       CAST(least((SELECT count_if(recommendation = 'buy') FROM v_picks), 3)
          + least((SELECT count_if(recommendation = 'sell') FROM v_picks), 3)
          + least((SELECT count_if(injury_risk >= 5) FROM v_dashboard), 5)
          + 2 * least((SELECT count(*) FROM v_fdr), 3)
          + least((SELECT count_if(form_trend = 'improving') FROM v_dashboard), 5)
          + least((SELECT count_if(form_trend = 'declining') FROM v_dashboard), 5) AS BIGINT) AS doc_list_items,
       CAST(least((SELECT count(DISTINCT t) FROM (SELECT unnest(key_themes) AS t FROM (
          SELECT key_themes FROM v_dashboard ORDER BY composite_rank, player_id LIMIT 50) a) b), 5) AS BIGINT)
          AS doc_themes,
       (SELECT CAST(count(*) AS BIGINT) FROM v_fixtures WHERE event IS NULL) AS dlq_rows
FROM v_dashboard""", "v_dashboard", "v_picks", "v_fixtures", "v_fdr")


@query("idempotent_write")
def _(c: Context):
    """History written for gameweeks 1-20, then 15-30 without force:
    only the absent partitions (21-30) are written."""
    path = scratch_path(c.spark, "idempotent")
    h = _history_cols(c)
    first = h.where(F.col("gameweek") <= 20).select("*", F.lit("first").alias("batch"))
    second = h.where(F.col("gameweek") >= 15).select("*", F.lit("second").alias("batch"))
    sinks.write_if_absent(first, path, ["season", "gameweek"])
    sinks.write_if_absent(second, path, ["season", "gameweek"])
    return sinks.read_partitioned(c.spark, path).select("season", "gameweek", "player_id", "composite_score", "batch")


oracle("idempotent_write", """
SELECT season, gameweek, player_id, composite_score, CASE WHEN gameweek <= 20 THEN 'first' ELSE 'second' END AS batch
FROM v_history""", "v_history")

# --- streaming ----------------------------------------------------------------------------------------

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])

EVENT_EXPECT = quality.Expectations(not_null=("event_id", "user_id", "event_type", "ts"),
                                    value_ranges={"value": {"min": 0, "max": 400}})


LATE_DAY = 10          # faulty deliveries below concern rows up to this day of the month
DELAY = "7 days"       # watermark of the event streams: the input spans 30 days
N_CHUNKS = 10          # deliveries of three days each
# Rows that arrive one delivery after their own, and rows that arrive last of
# all, far behind the watermark.
_DELAYED, _LATE = "event_id % 10 = 3", f"event_id % 50 = 7 AND dayofmonth(ts) <= {LATE_DAY}"
_LATE_SQL = f"event_id % 50 = 7 AND day(ts) <= {LATE_DAY}"


def _events(c: Context):
    return c.t.events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type",
                             "value", "props")


def _chunk():
    return F.least(F.floor((F.dayofmonth("ts") - 1) / 3), F.lit(N_CHUNKS - 1)).cast("int")


def _deliveries(c: Context, d: dict, order=None, disordered: bool = False):
    """Events as deliveries of three days; disordered: with rows that come one
    delivery late (within the watermark) and rows that come last (behind it)."""
    chunk = _chunk()
    if disordered:
        chunk = F.when(F.expr(_LATE), N_CHUNKS + 1).when(F.expr(_DELAYED), chunk + 1).otherwise(chunk)
    return jobs.chunk_deliveries(_events(c), d["landing"], chunk, order or range(N_CHUNKS + 2 * disordered))


def _ev_out(df):
    return df.select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "user_id", "event_type", "value")


_EV_SQL = "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, user_id, event_type, value FROM events"


# Faults put into the ingested events: nulls in required columns.
_INGEST_FAULTS = {"user_id": 37, "event_type": 41}


@query("stream_ingest")
def _(c: Context):
    """Landing zone -> clean table + dead-letter queue (foreachBatch,
    checkpointed, idempotent by batch id), both read back."""
    d = jobs.fresh_dirs(c.spark, "t1")
    e = _events(c)
    for col, n in _INGEST_FAULTS.items():
        e = e.withColumn(col, F.when(F.col("event_id") % n != 0, F.col(col)))
    for n, land in enumerate(jobs.chunk_deliveries(e, d["landing"], _chunk(), range(N_CHUNKS)), 1):
        land()
        if n % 4 == 0 or n == N_CHUNKS:  # four deliveries are one batch
            jobs.ingest_with_quarantine(c.spark, d["landing"], EVENT_SCHEMA, EVENT_EXPECT, "event_id", d["out"],
                                        d["dlq"], [], d["ckpt"])
    clean = _ev_out(c.spark.read.schema(EVENT_SCHEMA).parquet(d["out"])).withColumn("errors", F.lit(""))
    dlq = c.spark.read.schema("event_id long, record string, errors array<string>").json(d["dlq"])
    bad = dlq.select("*", F.from_json("record", EVENT_SCHEMA.simpleString()).alias("r")).select(
        "event_id", F.date_format("r.ts", "yyyy-MM-dd").alias("day"), "r.user_id", "r.event_type", "r.value",
        F.array_join("errors", "|").alias("errors"))
    return clean.unionByName(bad)


oracle("stream_ingest", """
SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, CASE WHEN event_id % 37 <> 0 THEN user_id END AS user_id,
       CASE WHEN event_id % 41 <> 0 THEN event_type END AS event_type, value,
       array_to_string(list_filter([
         CASE WHEN event_id % 37 = 0 THEN 'null value in required column ' || chr(39) || 'user_id' || chr(39) END,
         CASE WHEN event_id % 41 = 0 THEN 'null value in required column ' || chr(39) || 'event_type' || chr(39) END],
         lambda x: x IS NOT NULL), '|') AS errors FROM events""")


@query("stream_dedupe")
def _(c: Context):
    """Re-delivered chunks removed by dropDuplicatesWithinWatermark: one
    comes again at once (known in the state), one comes again weeks later
    (behind the watermark); state is kept for a week of 30 days."""
    d = jobs.fresh_dirs(c.spark, "t2")
    deliveries = _deliveries(c, d, order=[0, 1, 1, *range(2, N_CHUNKS), 0])

    def start():
        s = jobs.stream_files(c.spark, d["landing"], EVENT_SCHEMA, files_per_batch=None)
        s = s.withWatermark("ts", DELAY).dropDuplicatesWithinWatermark(["event_id"])
        return s.writeStream.format("parquet").option("path", d["out"]).option("checkpointLocation", d["ckpt"])
    jobs.run_deliveries(c.spark, deliveries, start, "dedupe")
    return _ev_out(c.spark.read.schema(EVENT_SCHEMA).parquet(d["out"]))


oracle("stream_dedupe", _EV_SQL)


@query("stream_session_windows")
def _(c: Context):
    """T5: session windows as a stream: sessions that grow over deliveries,
    rows that bridge two of them a delivery later, late rows dropped.  A last
    marker row moves the watermark past every session."""
    from tallyframe.plans.group_ledger import SESSION_GAP
    d = jobs.fresh_dirs(c.spark, "t5s")
    marker = c.spark.createDataFrame([(-1, None, None, None, None, None)], EVENT_SCHEMA).withColumn(
        "ts", F.lit("2025-01-01 00:00:00").cast("timestamp"))
    deliveries = [*_deliveries(c, d, disordered=True), lambda: marker.write.mode("append").parquet(d["landing"])]

    def start():
        s = jobs.session_stream(jobs.stream_files(c.spark, d["landing"], EVENT_SCHEMA, files_per_batch=None),
                                "user_id", SESSION_GAP, DELAY)
        return jobs.per_batch_folders(s, d["out"], lambda batch: batch).outputMode("append") \
            .option("checkpointLocation", d["ckpt"])
    jobs.run_deliveries(c.spark, deliveries, start, "session_windows")
    return c.spark.read.parquet(d["out"]).select("user_id", "session_start", "session_end", "attempts")


@query("stream_ledger")
def _(c: Context):
    """Tokens per (day window, model); update mode into a keyed log of
    runs; rows that arrive behind the watermark do not change a closed day."""
    from tallyframe.plans.group_ledger import EVENT_MODEL
    d = jobs.fresh_dirs(c.spark, "t3")
    deliveries = _deliveries(c, d, disordered=True)
    model = F.lit("unknown-model")
    for k, v in reversed(list(EVENT_MODEL.items())):
        model = F.when(F.col("event_type") == k, F.lit(v)).otherwise(model)
    sink = jobs.KeyedRuns(d["out"], ["day", "model"])

    def start():
        s = jobs.stream_files(c.spark, d["landing"], EVENT_SCHEMA, files_per_batch=None)
        u = s.select("ts", model.alias("model"), F.round(F.col("value") * 100).cast("bigint").alias("tokens"))
        g = (u.withWatermark("ts", DELAY).groupBy(F.window("ts", "1 day"), "model")
              .agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("calls")))
        g = g.select(F.date_format(F.col("window.start"), "yyyy-MM-dd").alias("day"), "model", "tokens", "calls")
        return g.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", d["ckpt"])
    jobs.run_deliveries(c.spark, deliveries, start, "ledger")
    return sink.latest(c.spark)


oracle("stream_ledger", f"""
SELECT day, model, CAST(sum(input_tokens) AS BIGINT) AS tokens, CAST(count(*) AS BIGINT) AS calls
FROM v_usage WHERE NOT ({_LATE_SQL}) GROUP BY day, model""", "v_usage")


@query("stream_sessions")
def _(c: Context):
    """T5: attempts per user in sliding 1-hour windows every 30 minutes."""
    d = jobs.fresh_dirs(c.spark, "t5")
    sink = jobs.KeyedRuns(d["out"], ["user_id", "window_start"])

    def start():
        s = jobs.stream_files(c.spark, d["landing"], EVENT_SCHEMA, files_per_batch=None)
        g = (s.withWatermark("ts", DELAY).groupBy("user_id", F.window("ts", "60 minutes", "30 minutes"))
              .agg(F.count(F.lit(1)).alias("attempts")))
        g = g.select("user_id", F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("window_start"), "attempts")
        return g.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", d["ckpt"])
    jobs.run_deliveries(c.spark, _deliveries(c, d), start, "sessions", per_batch=4)
    return sink.latest(c.spark)


oracle("stream_sessions", """
SELECT user_id, strftime(ws, '%Y-%m-%d %H:%M') AS window_start, CAST(count(*) AS BIGINT) AS attempts FROM (
  SELECT user_id, time_bucket(INTERVAL 30 MINUTE, ts) AS ws FROM events
  UNION ALL
  SELECT user_id, time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE FROM events) x
GROUP BY user_id, ws""")


@query("stream_admission")
def _(c: Context):
    """T4: stateful per-session admission (applyInPandasWithState, event-time
    timeout); rows-only check, equal to the batch ``rate_admission``."""
    from tallyframe.plans.group_ledger import LONG_N, LONG_S, SHORT_N, SHORT_S
    d = jobs.fresh_dirs(c.spark, "t4")
    secs = (F.unix_date(F.to_date("ts")).cast("bigint") * 86400 + F.hour("ts") * 3600
            + F.minute("ts") * 60 + F.second("ts"))
    period = F.floor((F.dayofmonth("ts") - 1) / 8).cast("int")
    for i in range(4):  # each delivery is one batch of a stream that restarts from its checkpoint
        _events(c).where(period == i).write.mode("append").parquet(d["landing"])
        s = jobs.stream_files(c.spark, d["landing"], EVENT_SCHEMA, files_per_batch=1_000_000)
        r = s.select("ts", F.col("user_id").alias("session_id"), F.col("event_id").alias("request_id"),
                     secs.alias("t"))
        a = jobs.admission_stream(r, SHORT_S, SHORT_N, LONG_S, LONG_N)
        w = a.writeStream.format("parquet").option("path", d["out"]).option("checkpointLocation", d["ckpt"]) \
             .outputMode("append")
        jobs.run_available_now(w, "admission")
    return c.spark.read.schema(jobs.ADMIT_OUT).parquet(d["out"])


@query("stream_article_match")
def _(c: Context):
    """A document stream matched against the static benchmark passages;
    each micro-batch runs the batch join and writes a folder of its own."""
    d = jobs.fresh_dirs(c.spark, "t6")
    docs = c.t.documents.select("doc_id", "text")
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])

    def start():
        s = jobs.stream_files(c.spark, d["landing"], schema, files_per_batch=None)
        return jobs.per_batch_folders(s, d["out"], lambda batch: enrich.containment_join(
            c.t.benchmark, batch, "item_id", "text", "doc_id", "text")).option("checkpointLocation", d["ckpt"])
    deliveries = jobs.chunk_deliveries(docs, d["landing"], (F.col("doc_id") % 3).cast("int"), range(3))
    jobs.run_deliveries(c.spark, deliveries, start, "article_match", per_batch=4)
    return c.spark.read.parquet(d["out"]).select("item_id", "doc_id")


oracle("stream_article_match", """
SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d
  ON length(b.text) > 0 AND strpos(lower(d.text), lower(b.text)) > 0""")


@query("stream_upsert")
def _(c: Context):
    """Latest event per (user, type) kept in a log of sorted runs; each
    micro-batch reduces itself (max_by), runs are compacted level by level."""
    d = jobs.fresh_dirs(c.spark, "t7")
    sink = jobs.KeyedRuns(d["out"], ["user_id", "event_type"], ["ts", "event_id"])

    def start():
        s = jobs.stream_files(c.spark, d["landing"], EVENT_SCHEMA, files_per_batch=None)
        return s.writeStream.foreachBatch(sink).option("checkpointLocation", d["ckpt"])
    jobs.run_deliveries(c.spark, _deliveries(c, d), start, "upsert", per_batch=4)
    return _ev_out(sink.latest(c.spark))


oracle("stream_upsert", """
SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, user_id, event_type, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""")
