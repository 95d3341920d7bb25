"""Streaming jobs and sinks: quarantine, idempotent replays, write-if-absent."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.operators import quality
from tallyframe.session import scratch_path
from tallyframe.sources import sinks
from tallyframe.streaming import jobs
from tests.conftest import rows

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType()),
                       T.StructField("v", T.LongType())])


def test_ingest_with_quarantine_splits_clean_and_dlq(spark):
    d = jobs.fresh_dirs(spark, "t-ingest")
    df = spark.createDataFrame([(1, "a", 5), (2, None, 7), (3, "c", 999)], SCHEMA)
    jobs.land_in_chunks(df, d["landing"], F.col("id") % 2, 2)
    exp = quality.Expectations(not_null=("name",), value_ranges={"v": {"max": 100}})
    jobs.ingest_with_quarantine(spark, d["landing"], SCHEMA, exp, "id", d["out"], d["dlq"], [], d["ckpt"])
    assert rows(spark.read.schema(SCHEMA).parquet(d["out"]), "id") == [(1,), (3,)]  # warnings stay valid
    dlq = spark.read.json(d["dlq"]).collect()
    assert [r.id for r in dlq] == [2] and dlq[0].errors == ["null value in required column 'name'"]
    # a restart from the same checkpoint finds nothing new and writes nothing twice
    jobs.ingest_with_quarantine(spark, d["landing"], SCHEMA, exp, "id", d["out"], d["dlq"], [], d["ckpt"])
    assert spark.read.schema(SCHEMA).parquet(d["out"]).count() == 2


def _size(path):
    import os
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs)


def test_keyed_runs_replays_compacts_and_writes_by_the_batch(spark):
    root = scratch_path(spark, "t-upsert")
    sink = jobs.KeyedRuns(root, ["id"], ["v"], fan_in=3)
    sink(spark.createDataFrame([(i, f"n{i}", 1) for i in range(20_000)], SCHEMA), 0)
    first = _size(root)
    b1 = spark.createDataFrame([(3, "new", 2), (4, "old", 0), (25_000, "x", 1), (3, "twice", 2)], SCHEMA)
    sink(b1.where("name <> 'twice'"), 1)
    assert _size(root) - first < first / 10  # a small batch writes little, whatever the table's size
    sink(b1, 1)  # replay of a committed batch: skipped
    before = rows(sink.latest(spark), "id", "name")
    assert len(before) == 20_001 and dict(before)[3] == "new" and dict(before)[4] == "n4"
    # a batch that failed before its manifest: its run is there, the table is not changed
    sink._write(b1.withColumn("_batch", F.lit(2).cast("long")), "runs/000000000002-0")
    assert rows(sink.latest(spark), "id", "name") == before
    sink(spark.createDataFrame([(7, "seven", 5), (None, "none", 1), (None, "null", 2)], SCHEMA), 2)  # third run: compacted
    assert [r["level"] for r in sink.runs(spark)] == [1]
    for b in range(3, 6):
        sink(spark.createDataFrame([(8, f"b{b}", b)], SCHEMA), b)
    sink(b1.limit(0), 6)
    got = {r.id: r.name for r in sink.latest(spark).collect()}
    assert got[7] == "seven" and got[8] == "b5" and got[None] == "null" and len(got) == 20_002
    assert sorted(r["level"] for r in sink.runs(spark)) == [1, 1]
    old = sink.vacuum(spark)
    assert len(old) >= 6 and {r.id: r.name for r in sink.latest(spark).collect()} == got
    sink(spark.createDataFrame([(8, "again", 9)], SCHEMA), 5)  # replay of an old batch after vacuum
    assert {r.id: r.name for r in sink.latest(spark).collect()} == got


def test_sessions_merge_across_batches(spark):
    d = jobs.fresh_dirs(spark, "t-sessions")
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("ts", T.TimestampType())])

    def land(*minutes):
        spark.createDataFrame([(k, m) for k, m in minutes], "k string, m int").select(
            "k", F.timestamp_seconds(F.col("m") * 60 + 1_700_000_000).alias("ts")).coalesce(1) \
            .write.mode("append").parquet(d["landing"])
        s = jobs.session_stream(jobs.stream_files(spark, d["landing"], schema), "k", "10 minutes", "60 minutes")
        w = jobs.per_batch_folders(s, d["out"], lambda b: b).outputMode("append").option("checkpointLocation", d["ckpt"])
        jobs.run_available_now(w, "t_sessions")

    land(("a", 0), ("a", 15), ("b", 3), (None, 1))      # two sessions of a
    land(("a", 8), ("b", 40))                            # bridges them
    land(("c", 200))                                     # closes all of the above
    land(("a", 9), ("c", 205))                           # late: dropped
    land(("z", 1000))
    out = spark.read.parquet(d["out"])
    got = sorted((r.k or "", int((r.session_start.timestamp() - 1_700_000_000) / 60), r.attempts) for r in out.collect())
    assert got == [("", 1, 1), ("a", 0, 3), ("b", 3, 1), ("b", 40, 1), ("c", 200, 2)]


def test_write_if_absent_skips_existing_partitions(spark):
    path = scratch_path(spark, "t-absent")
    cols = "season string, gameweek int, x int"
    sinks.write_if_absent(spark.createDataFrame([("s", 1, 1), ("s", 2, 2)], cols), path, ["season", "gameweek"])
    written = sinks.write_if_absent(spark.createDataFrame([("s", 2, 99), ("s", 3, 3)], cols), path,
                                    ["season", "gameweek"])
    assert rows(written, "gameweek", "x") == [(3, 3)]
    assert rows(sinks.read_partitioned(spark, path), "gameweek", "x") == [(1, 1), (2, 2), (3, 3)]
    sinks.write_if_absent(spark.createDataFrame([("s", 2, 42)], cols), path, ["season", "gameweek"], force=True)
    assert rows(sinks.read_partitioned(spark, path), "gameweek", "x") == [(1, 1), (2, 42), (3, 3)]


def test_dropduplicates_within_watermark_removes_redelivery(spark):
    d = jobs.fresh_dirs(spark, "t-dedupe")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("ts", T.TimestampType())])
    df = spark.createDataFrame([(i, None) for i in range(6)], "id long, ts timestamp") \
              .select("id", F.timestamp_seconds(F.col("id") * 60 + 1_700_000_000).alias("ts"))
    jobs.land_in_chunks(df, d["landing"], (F.col("id") % 2).cast("int"), 2, repeat_chunk=0)
    s = jobs.stream_files(spark, d["landing"], schema).withWatermark("ts", "1 day") \
            .dropDuplicatesWithinWatermark(["id"])
    w = s.writeStream.format("parquet").option("path", d["out"]).option("checkpointLocation", d["ckpt"])
    jobs.run_available_now(w, "t_dedupe")
    assert sorted(r.id for r in spark.read.schema(schema).parquet(d["out"]).collect()) == list(range(6))


def test_late_rows_after_watermark_are_dropped_in_stream_but_counted_in_batch(spark):
    d = jobs.fresh_dirs(spark, "t-late")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("ts", T.TimestampType()),
                           T.StructField("tokens", T.LongType())])
    base = 1_700_000_000
    on_time = spark.createDataFrame([(i, None, 10) for i in range(6)], "id long, ts timestamp, tokens long") \
        .select("id", F.timestamp_seconds(F.lit(base) + F.col("id") * 86400).alias("ts"), "tokens")
    late = spark.createDataFrame([(100, None, 1000)], "id long, ts timestamp, tokens long") \
        .select("id", F.timestamp_seconds(F.lit(base)).alias("ts"), "tokens")  # day 0, after day 5
    jobs.land_in_chunks(on_time, d["landing"], F.lit(0), 1)
    s = jobs.stream_files(spark, d["landing"], schema, files_per_batch=1000)
    g = (s.withWatermark("ts", "1 day").groupBy(F.window("ts", "1 day").alias("w"))
          .agg(F.sum("tokens").alias("tokens"))
          .select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "tokens"))
    sink = jobs.KeyedRuns(d["out"], ["day"])
    w = g.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", d["ckpt"])
    jobs.run_available_now(w, "t_late1")
    jobs.land_in_chunks(late, d["landing"], F.lit(0), 1)   # arrives after the watermark moved on
    jobs.run_available_now(w, "t_late2")
    streamed = sum(r.tokens for r in sink.latest(spark).collect())
    batch = on_time.unionByName(late).agg(F.sum("tokens")).first()[0]
    assert streamed == 60 and batch == 1060


def test_batches_follow_the_deliveries_not_their_files(spark):
    import os
    d = jobs.fresh_dirs(spark, "t-deliveries")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("ts", T.TimestampType())])
    df = spark.range(60).repartition(6).select("id", F.timestamp_seconds(F.col("id") * 3600 + 1_700_000_000).alias("ts"))
    chunk = F.when(F.col("id") == 1, 3).otherwise(F.floor(F.col("id") / 20)).cast("int")  # row 1 comes last: late
    deliveries = jobs.chunk_deliveries(df, d["landing"], chunk, [0, 1, 1, 2, 3])

    def start():
        s = jobs.stream_files(spark, d["landing"], schema, files_per_batch=None)
        s = s.withWatermark("ts", "1 hour").dropDuplicatesWithinWatermark(["id"])
        return s.writeStream.format("parquet").option("path", d["out"]).option("checkpointLocation", d["ckpt"])
    before = spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled")
    jobs.run_deliveries(spark, deliveries, start, "t_deliveries")
    assert spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled") == before
    files = [f for f in os.listdir(d["landing"]) if f.startswith("part-")]
    batches = [f for f in os.listdir(d["ckpt"] + "/commits") if f.isdigit()]
    assert len(files) > 8 and len(batches) <= 6  # five deliveries and one batch without data
    assert sorted(r.id for r in spark.read.parquet(d["out"]).collect()) == [0, *range(2, 60)]
