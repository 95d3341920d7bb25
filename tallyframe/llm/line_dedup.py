"""Line deduplication with levelled sorted runs of line hashes.

A line's key is the line stripped of ASCII white space and with A-Z
lower-cased; keys of at least ``min_chars`` code points count.  A key held by
at least ``min_docs`` documents loses its lines everywhere except in the
document with the largest ``doc_id`` that holds it.

``LineRuns`` keeps what is known of keys as runs: Parquet tables sorted by key
hash (128 bits), each row a hash, the number of documents seen with it and
the largest ``doc_id``.  A new batch is aggregated, merge-anti-joined with the
runs (a key already *settled* there, seen in ``min_docs`` documents, needs no
more rows) and written as a run of its own at level 0.  When a level holds
``fanout`` runs they are compacted into one run of the next level.  Batches go
in descending ``doc_id``, so a settled key's largest ``doc_id`` is final.

Only 16-byte hashes and ids are exchanged to find the lines; the texts move
once, to meet their lists of dropped hashes.  Counts combine before the
exchange, and the join with the hot keys is between two plain exchanges that
adaptive execution can split.

Defined cases: a null or empty text is one empty line, never dropped; a null
``doc_id`` is smaller than any other; each row counts as a document, and rows
that share a ``doc_id`` lose and keep the same keys; an empty table gives an
empty result; all other columns pass through ``drop_lines``; names beginning
``_ld_`` are reserved.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm._text import text_column
from tallyframe.session import scratch_path

MIN_CHARS = 20
MIN_DOCS = 3
BATCHES = 4
FANOUT = 4
_STRIP = b" \t\n\x0b\x0c\r"


def line_keys(text: str, min_chars: int = MIN_CHARS) -> list[bytes | None]:
    """Hash of each line's key; None where the key is too short."""
    out = []
    for line in text.encode("utf-8", "surrogatepass").split(b"\n"):
        key = line.lower().strip(_STRIP)  # bytes: A-Z and ASCII white space alone
        if len(key) < min_chars or (not key.isascii() and len(key.decode("utf-8", "surrogatepass")) < min_chars):
            out.append(None)
        else:
            out.append(hashlib.blake2b(key, digest_size=16).digest())
    return out


def key_rows(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(``h1``, ``h2``, ``doc_id``): one row per document and distinct key."""

    def task(batches):
        for b in batches:
            digests, counts = [], []
            for t in text_column(b).to_pylist():
                found = {k for k in line_keys(t, min_chars) if k is not None}
                digests += sorted(found)
                counts.append(len(found))
            h = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            at = pa.array(np.repeat(np.arange(b.num_rows), counts))
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[:, 0]), pa.array(h[:, 1]), b.column("doc_id").take(at)], ["h1", "h2", "doc_id"])

    return docs.select("doc_id", "text").mapInArrow(task, "h1 long, h2 long, doc_id long")


class LineRuns:
    """Levelled sorted runs under one folder of shared storage."""

    def __init__(self, spark: SparkSession, path: str, min_docs: int = MIN_DOCS, fanout: int = FANOUT):
        self.spark, self.path, self.min_docs, self.fanout = spark, path, min_docs, fanout
        self.levels: list[list[str]] = []
        self._written = 0

    def _write(self, level: int, counts: DataFrame) -> None:
        path = f"{self.path}/run-{self._written:04d}-level-{level}"
        self._written += 1
        counts.sortWithinPartitions("h1", "h2").write.parquet(path)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)

    def _read(self) -> DataFrame:
        return self.spark.read.schema("h1 long, h2 long, n_docs long, last_doc long").parquet(
            *[p for level in self.levels for p in level])

    @staticmethod
    def _merged(runs: DataFrame) -> DataFrame:
        return runs.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))

    def add(self, keys: DataFrame) -> None:
        """Add a batch of key rows (``h1``, ``h2``, ``doc_id``)."""
        batch = keys.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc"))
        if any(self.levels):
            settled = self._read().where(F.col("n_docs") >= self.min_docs).select("h1", "h2")
            batch = batch.join(settled, ["h1", "h2"], "left_anti")
        self._write(0, batch)
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            self.compact(level)
            level += 1

    def compact(self, level: int) -> None:
        """Merge the runs of a level into one run of the next."""
        runs = self.spark.read.parquet(*self.levels[level])
        self.levels[level] = []
        self._write(level + 1, self._merged(runs))

    def repeated(self) -> DataFrame:
        """(``h1``, ``h2``, ``last_doc``) of the keys in ``min_docs`` documents."""
        return self._merged(self._read()).where(F.col("n_docs") >= self.min_docs).select("h1", "h2", "last_doc")


def dropped_keys(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES,
                 fanout: int = FANOUT) -> DataFrame:
    """(``doc_id``, ``keys``): the key hashes whose lines the document loses."""
    spark = docs.sparkSession
    root = scratch_path(spark, "line-dedup")
    shares = [i / batches for i in range(1, batches)]
    cuts = sorted(set(docs.approxQuantile("doc_id", shares, 0.01)), reverse=True) if shares else []
    batch = F.lit(len(cuts))
    for i in reversed(range(len(cuts))):
        batch = F.when(F.col("doc_id") > cuts[i], i).otherwise(batch)
    key_rows(docs, min_chars).withColumn("batch", batch).write.partitionBy("batch").parquet(f"{root}/keys")
    keys = spark.read.schema("h1 long, h2 long, doc_id long, batch int").parquet(f"{root}/keys")
    runs = LineRuns(spark, root, min_docs, fanout)
    for i in range(len(cuts) + 1):
        runs.add(keys.where(F.col("batch") == i).select("h1", "h2", "doc_id"))
    runs.repeated().write.parquet(f"{root}/repeated")
    repeated = spark.read.parquet(f"{root}/repeated")
    lost = (keys.select("h1", "h2", "doc_id").join(repeated, ["h1", "h2"])
            .where(~F.col("doc_id").eqNullSafe(F.col("last_doc"))))
    # As long as the document's list of lines, at most.
    return lost.groupBy("doc_id").agg(F.collect_set(F.struct("h1", "h2")).alias("keys"))


def drop_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES,
               fanout: int = FANOUT) -> DataFrame:
    """The documents with repeated lines dropped from ``text``, and
    ``_ld_lines`` and ``_ld_dropped``: the numbers of lines before and lost."""
    lost = dropped_keys(docs, min_chars, min_docs, batches, fanout).select(
        F.col("doc_id").alias("_ld_id"), F.col("keys").alias("_ld_keys"))
    joined = docs.join(lost, F.col("doc_id").eqNullSafe(F.col("_ld_id")), "left").drop("_ld_id")
    schema = T.StructType([*docs.schema.fields, T.StructField("_ld_lines", T.LongType()),
                           T.StructField("_ld_dropped", T.LongType())])

    def task(batches):
        for b in batches:
            texts, lines, dropped = [], [], []
            for t, lost in zip(b.column("text").to_pylist(), b.column("_ld_keys").to_pylist()):
                parts = (t or "").split("\n")
                lines.append(len(parts))
                if lost:
                    gone = {np.array([k["h1"], k["h2"]], "<i8").tobytes() for k in lost}
                    kept = [p for p, k in zip(parts, line_keys(t, min_chars)) if k not in gone]
                    dropped.append(len(parts) - len(kept))
                    t = "\n".join(kept)
                else:
                    dropped.append(0)
                texts.append(t)
            cols = {n: b.column(n) for n in b.schema.names}
            cols |= {"text": pa.array(texts, b.column("text").type), "_ld_lines": pa.array(lines, pa.int64()),
                     "_ld_dropped": pa.array(dropped, pa.int64())}
            yield pa.RecordBatch.from_arrays([cols[f.name] for f in schema.fields], [f.name for f in schema.fields])

    return joined.mapInArrow(task, schema)
