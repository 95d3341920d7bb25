"""Token ids in Parquet: list columns with dictionary and delta encoding.

``write_token_files`` lays documents out in ascending ``doc_id`` order.  Each
file holds one contiguous range of ids, sorted, with

* ``ids`` (list of int) dictionary-encoded: a page stores bit-packed codes;
* ``doc_id``, ``n_tokens``, ``local_start`` delta-encoded (format v2 pages);
* row groups and pages of a set size, with Parquet's column and offset
  indexes, so a reader of few documents or of the metadata columns alone
  skips the pages of all other ids.

The start of a document among all ids is the total of the files before plus
its ``local_start``; the files' totals come from two narrow columns.

Defined cases: a null text is the empty text (its end id alone); a null
``doc_id`` comes first; rows with equal ``doc_id`` follow each other by text;
an empty table gives empty files; other columns of the input are ignored, or
kept when named in ``keep``.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.llm._text import runs, text_column
from tallyframe.llm._tokens import encoder

ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 1 << 20
PAGE_ROWS = 2_000
_OWN = ("doc_id", "ids", "n_tokens", "local_start", "file_no")


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, keep: tuple[str, ...] = (),
                      row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES,
                      page_rows: int = PAGE_ROWS) -> None:
    """Encode every text and write the files under ``path``.

    One range exchange of the texts by ``doc_id``; the tokenizer runs after
    it, so ids are written where they are made.  The written files are the
    only place where file numbers are assigned: a lost executor's task is
    redone with the same range and the same number.
    """
    taken = [c for c in keep if c in _OWN]
    if taken:
        raise ValueError(f"columns {taken} clash with the columns of the token files")
    src = docs.select("doc_id", "text", *keep)
    ordered = (src.repartitionByRange(F.col("doc_id").asc_nulls_first())
               .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()))
    kept_schema = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields if f.name in keep)

    def encode(batches):
        no = TaskContext.get().partitionId()
        at = 0
        for b in batches:
            col = text_column(b)
            for lo, hi in runs(col):  # small results: few ids are held at a time
                ids, off = encoder(tokenizer).encode(col.slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(lo, hi - lo),
                     pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids.view(np.int32))),
                     pa.array(np.diff(off)), pa.array(at + off[:-1]), pa.array(np.full(hi - lo, no, np.int32)),
                     *[b.column(c).slice(lo, hi - lo) for c in keep]],
                    [*_OWN, *keep])
                at += int(off[-1])

    (ordered.mapInArrow(encode, "doc_id long, ids array<int>, n_tokens long, local_start long, file_no int" + kept_schema)
     .write.mode("errorifexists")
     .option("compression", "zstd")
     .option("parquet.writer.version", "PARQUET_2_0")
     .option("parquet.enable.dictionary", "false")
     .option("parquet.enable.dictionary#ids.list.element", "true")
     .option("parquet.block.size", row_group_bytes)
     .option("parquet.page.size", page_bytes)
     .option("parquet.page.row.count.limit", page_rows)
     .parquet(path))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start`` and ``n_tokens`` of every document; the ids stay unread."""
    return _with_start(spark, path).drop("ids", "local_start", "file_no")


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """Documents with their ids; of ``doc_ids`` alone if given (a short list:
    the filter reaches row groups and pages)."""
    out = _with_start(spark, path)
    if doc_ids is not None:
        out = out.where(F.col("doc_id").isin([int(x) for x in doc_ids]))
    return out.drop("local_start", "file_no")


def _with_start(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.parquet(path)
    # One row per written file: as small as the list of files.
    totals = files.groupBy("file_no").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("file_no", F.coalesce(
        F.sum("n").over(Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return (files.join(F.broadcast(before), "file_no")
            .withColumn("start", F.col("base") + F.col("local_start")).drop("base"))


def token_digests(tokens: DataFrame) -> DataFrame:
    """``ids_crc32`` in place of ``ids``: CRC-32 of the ids as little-endian
    unsigned 32-bit integers."""
    rest = [f for f in tokens.schema.fields if f.name != "ids"]

    def digest(batches):
        for b in batches:
            lists = b.column("ids")
            values = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False))
            off = lists.offsets.to_numpy()
            crc = [zlib.crc32(values[lo:hi]) for lo, hi in zip(off[:-1].tolist(), off[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in rest], pa.array(crc, pa.int64())],
                                             [*[f.name for f in rest], "ids_crc32"])

    return tokens.mapInArrow(digest, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)
                             + ", ids_crc32 long")
