"""Structured Streaming counterparts.

Every job reads a file landing zone with a DECLARED schema, is
checkpointed in shared storage (``spark.checkpoint.dir``), and writes
through an idempotent sink: file sinks in append mode for stateless jobs,
``foreachBatch`` keyed upserts into versioned tables for stateful ones
(a batch id that was already committed is skipped, so a replay after an
executor or driver loss cannot double-apply).
"""

from __future__ import annotations

import json
import uuid
from collections import deque
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from tallyframe.operators import quality
from tallyframe.operators.clean import latest_per_key
from tallyframe.session import scratch_path


# --- landing zone -------------------------------------------------------------------------

def chunk_deliveries(df: DataFrame, path: str, chunk_col, order) -> list[Callable[[], None]]:
    """The deliveries of ``df`` to a landing folder, one call for each chunk of
    ``order`` (a chunk may come twice).  The rows are dealt to their chunks in
    one pass; a delivery then reads its own chunk, not the whole table."""
    c = df.select("*", chunk_col.alias("_chunk"))
    spark, staged = df.sparkSession, scratch_path(df.sparkSession, "deliveries")
    c.write.partitionBy("_chunk").parquet(staged)
    rows = spark.read.schema(c.schema).parquet(staged)

    def deliver(i: int) -> Callable[[], None]:
        return lambda: rows.where(F.col("_chunk") == i).drop("_chunk").write.mode("append").parquet(path)
    return [deliver(i) for i in order]


def land_in_chunks(df: DataFrame, path: str, chunk_col, n_chunks: int, repeat_chunk: int | None = None,
                   order=None) -> None:
    """Write ``df`` into a landing folder as ``n_chunks`` successive appends
    (files arrive in time order, as a feed would deliver them); optionally
    re-deliver one chunk at the end (duplicates for T2), or deliver the chunks
    of ``order``, one after the other."""
    if order is None:
        order = list(range(n_chunks)) + ([repeat_chunk] if repeat_chunk is not None else [])
    for land in chunk_deliveries(df, path, chunk_col, order):
        land()


def stream_files(spark: SparkSession, path: str, schema: T.StructType,
                 files_per_batch: int | None = 4) -> DataFrame:
    """A stream of the files in ``path``; without ``files_per_batch`` a
    micro-batch takes all that have landed."""
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def run_available_now(writer, name: str) -> None:
    """Process everything that has landed, then stop (bounded test/batch
    mode; on a cluster the same job runs with a processing-time trigger)."""
    q = writer.trigger(availableNow=True).queryName(f"{name}_{uuid.uuid4().hex[:8]}").start()
    q.awaitTermination()
    if q.exception() is not None:  # pragma: no cover
        raise q.exception()


def run_deliveries(spark: SparkSession, deliveries, start: Callable[[], object], name: str,
                   per_batch: int = 1) -> None:
    """Land ``deliveries`` one after the other; behind every ``per_batch`` of
    them, and the last, the stream (``start`` makes its writer) goes on from
    its checkpoint and takes what has landed as ONE micro-batch.  The number of
    batches follows the deliveries, however many files one of them has.

    Batches without data, which only move on the state, run behind the last."""
    setting = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(setting)
    try:
        for n, land in enumerate(deliveries, 1):
            land()
            if n == len(deliveries):
                spark.conf.set(setting, before)
            elif n % per_batch == 0:
                spark.conf.set(setting, "false")
            else:
                continue
            run_available_now(start(), name)
    finally:
        spark.conf.set(setting, before)


# --- keyed table as a log of sorted runs (foreachBatch) -----------------------------------------

class KeyedRuns:
    """A keyed table maintained by ``foreachBatch`` as a log of runs.

    Each micro-batch writes ONE run: its rows reduced to the last one of each
    key, hash-partitioned and sorted by key.  ``fan_in`` runs of a level are
    compacted to one of the next, so what a batch writes follows the batch (a
    row is rewritten once per level, log of the number of batches), not the
    table.  A manifest per batch lists the runs that make up the table; it is
    written last, and a batch that has one is skipped, so a replay after a
    failure at any point leaves the same table: half-written runs of an
    attempt are overwritten by the next and named by no manifest.

    The last row of a key is the one largest by ``order``, then by batch;
    without ``order`` a later batch replaces earlier ones (update mode).
    ``vacuum`` deletes runs that no kept manifest names.
    """

    def __init__(self, root: str, keys, order=(), fan_in: int = 4):
        self.root = root.rstrip("/")
        self.keys, self.order, self.fan_in = list(keys), list(order), fan_in

    def _fs(self, spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p

    def _batches(self, spark: SparkSession) -> list[int]:
        """Ids of the batches whose manifest is complete, ascending."""
        fs, p = self._fs(spark, f"{self.root}/manifest")
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        done = [n for n in names if fs.exists(self._fs(spark, f"{self.root}/manifest/{n}/_SUCCESS")[1])]
        return sorted(int(n) for n in done)

    def runs(self, spark: SparkSession, batch_id: int | None = None) -> list[dict]:
        """Runs (``path``, ``level``) of the table as of a batch (the last)."""
        done = self._batches(spark)
        if not done:
            return []
        at = done[-1] if batch_id is None else batch_id
        return json.loads(spark.read.text(f"{self.root}/manifest/{at:012d}").first()[0])["runs"]

    def _last(self, df: DataFrame) -> DataFrame:
        return latest_per_key(df, self.keys, [*self.order, "_batch"])

    def _read(self, spark: SparkSession, runs: list[dict]) -> DataFrame:
        return spark.read.parquet(*[f"{self.root}/{r['path']}" for r in runs])

    def _write(self, df: DataFrame, path: str) -> None:
        """Rows of a run; those of ``_last`` are already hash-partitioned by key."""
        df.sortWithinPartitions(*map(F.col, self.keys)).write.mode("overwrite").parquet(f"{self.root}/{path}")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        done = self._batches(spark)
        if done and batch_id <= done[-1]:
            return  # already committed: replay after a failure
        runs = self.runs(spark)
        path = f"runs/{batch_id:012d}-0"
        last = self._last(batch.withColumn("_batch", F.lit(batch_id).cast("long")))
        self._write(last, path)
        # The batch is computed once, by the write; an empty run is not listed.
        if not spark.read.schema(last.schema).parquet(f"{self.root}/{path}").isEmpty():
            runs = [*runs, {"path": path, "level": 0}]
        level = 0
        while len(full := [r for r in runs if r["level"] == level]) >= self.fan_in:
            level += 1
            path = f"runs/{batch_id:012d}-{level}"
            self._write(self._last(self._read(spark, full)), path)
            runs = [r for r in runs if r not in full] + [{"path": path, "level": level}]
        text = json.dumps({"batch": batch_id, "runs": runs})
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(
            f"{self.root}/manifest/{batch_id:012d}")

    def latest(self, spark: SparkSession) -> DataFrame | None:
        """The table: the last row of every key over the runs in force."""
        runs = self.runs(spark)
        return self._last(self._read(spark, runs)).drop("_batch") if runs else None

    def vacuum(self, spark: SparkSession, keep: int = 1) -> list[str]:
        """Delete the manifests but the last ``keep``, and all runs of committed
        batches that none of those names; returns the deleted runs' paths."""
        done = self._batches(spark)
        if not done:
            return []
        kept = {r["path"] for b in done[-keep:] for r in self.runs(spark, b)}
        fs, p = self._fs(spark, f"{self.root}/runs")
        there = [f"runs/{s.getPath().getName()}" for s in fs.listStatus(p)] if fs.exists(p) else []
        old = [r for r in there if r not in kept and int(r.split("/")[1].split("-")[0]) <= done[-1]]
        for path in [*old, *[f"manifest/{b:012d}" for b in done[:-keep]]]:
            fs.delete(self._fs(spark, f"{self.root}/{path}")[1], True)
        return sorted(old)


def per_batch_folders(stream: DataFrame, path: str, result: Callable[[DataFrame], DataFrame]):
    """A writer whose micro-batches overwrite one folder each, named by the
    batch id: a replayed batch replaces what a failed attempt left."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        result(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return stream.writeStream.foreachBatch(sink)


# --- T1 ingest + quarantine ---------------------------------------------------------------------

def ingest_with_quarantine(spark: SparkSession, landing: str, schema: T.StructType, exp, id_col: str,
                           clean_path: str, dlq_path: str, partition_cols, ckpt: str) -> None:
    """Landing -> clean (partitioned) + dead-letter queue, one checked
    projection per micro-batch.  Both outputs of a batch go to a folder named
    by its id and overwrite what is there, so a replay after a failure at any
    point leaves each record once."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        checked = quality.record_checks(batch, exp, id_col).persist()
        ok = F.size("errors") == 0
        checked.where(ok).drop("errors", "warnings").write.mode("overwrite") \
            .partitionBy(*partition_cols).parquet(f"{clean_path}/batch={batch_id}")
        failed = checked.where(~ok)
        failed.select(F.col(id_col), F.to_json(F.struct(*batch.columns)).alias("record"), "errors",
                      *partition_cols).write.mode("overwrite").partitionBy(*partition_cols) \
            .json(f"{dlq_path}/batch={batch_id}")
        checked.unpersist()

    w = stream_files(spark, landing, schema, files_per_batch=None).writeStream.foreachBatch(sink) \
        .option("checkpointLocation", f"{ckpt}/stream")
    run_available_now(w, "ingest")


# --- T4 stateful admission --------------------------------------------------------------------------

ADMIT_OUT = T.StructType([T.StructField("session_id", T.LongType()), T.StructField("request_id", T.LongType()),
                          T.StructField("allowed", T.BooleanType())])
ADMIT_STATE = T.StructType([T.StructField("accepted", T.ArrayType(T.LongType()))])


def admission_stream(events: DataFrame, short_s: int, short_n: int, long_s: int, long_n: int,
                     delay: str = "2 days") -> DataFrame:
    """T4: per-session sliding admission with state = accepted timestamps
    (at most ``long_n``), carried from batch to batch; the event-time timeout
    drops a session's state once the watermark passes its last accepted time +
    the long window.  Requests are decided batch by batch, by time within a
    batch: batches in time order give what ``ledger.rate_admission`` gives.  A
    session's rows of ONE batch are two columns of numbers in memory."""

    def fn(key, pdfs, state):
        if state.hasTimedOut:
            state.remove()
            return
        acc = deque(state.get[0]) if state.exists else deque()
        # Two narrow columns of the session's rows in this micro-batch.
        t, ids = map(np.concatenate, zip(*[(p["t"].to_numpy(np.int64), p["request_id"].to_numpy(np.int64)) for p in pdfs]))
        turn = np.lexsort((ids, t))
        ok = np.zeros(len(t), bool)
        for i in turn:
            now = int(t[i])
            while acc and acc[0] < now - long_s:
                acc.popleft()
            if len(acc) < long_n and sum(x >= now - short_s for x in acc) < short_n:
                acc.append(now)
                ok[i] = True
        state.update((list(acc),))
        if acc:
            state.setTimeoutTimestamp(max(int((acc[-1] + long_s) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"session_id": key[0], "request_id": ids, "allowed": ok})

    return (events.withWatermark("ts", delay)
                  .groupBy("session_id")
                  .applyInPandasWithState(fn, ADMIT_OUT, ADMIT_STATE, "append", GroupStateTimeout.EventTimeTimeout))


# --- T5 session windows -----------------------------------------------------------------------------

def session_stream(events: DataFrame, key: str, gap: str, delay: str) -> DataFrame:
    """T5: sessions per key in the state store: rows closer than ``gap`` are
    one session, also when they arrive in different micro-batches, in any
    order, or when a row that comes later joins two sessions.  Append mode
    gives a session once, when the watermark (``delay`` behind the newest row)
    has passed its end; rows whose own session would end before it are late
    and dropped."""
    return (events.withWatermark("ts", delay).groupBy(key, F.session_window("ts", gap).alias("s"))
            .agg(F.count(F.lit(1)).alias("attempts"))
            .select(key, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "attempts"))


def fresh_dirs(spark: SparkSession, name: str) -> dict:
    base = scratch_path(spark, name)
    return {k: f"{base}/{k}" for k in ("landing", "out", "ckpt", "dlq")}
