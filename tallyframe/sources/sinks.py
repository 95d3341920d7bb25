"""Sinks: partitioned Parquet (zstd, dynamic partition overwrite), JSON
documents, dead-letter queue, schema-version stamp, idempotent writes and
partition listing.  All paths may be any Hadoop-compatible URI (shared
storage on a cluster)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION_CLEAN = "1.1.0"
SCHEMA_VERSION_CURATED = "1.0.0"


def stamp_version(df: DataFrame, version: str) -> DataFrame:
    """A ``schema_version`` column that survives every sink."""
    return df.select("*", F.lit(version).alias("schema_version"))


def write_partitioned(df: DataFrame, path: str, partition_cols, mode: str = "overwrite",
                      compression: str = "zstd", writers_per_partition: int = 8) -> None:
    """Hive-partitioned Parquet.  ``overwrite`` replaces ONLY the
    partitions present in ``df`` (dynamic partition overwrite), so a
    re-run of one gameweek never touches the others.

    Rows are clustered by (partition keys, deterministic salt): each task
    writes few partitions, and a partition holding a third of the data is
    still written by ``writers_per_partition`` tasks, not one."""
    cols = list(partition_cols)
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(writers_per_partition))
    (df.repartition(*[F.col(c) for c in cols], salt).sortWithinPartitions(*cols)
       .write.mode(mode).option("partitionOverwriteMode", "dynamic")
       .option("compression", compression).partitionBy(*cols).parquet(path))


def read_partitioned(spark: SparkSession, path: str, schema=None) -> DataFrame:
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.option("basePath", path).parquet(path)


def existing_partitions(spark: SparkSession, path: str, partition_cols) -> DataFrame:
    """Partition values already present (the listing comes from the
    file index; only the partition columns are read).  A missing folder means
    no table yet; any other failure to read is raised."""
    try:
        return read_partitioned(spark, path).select(*partition_cols).distinct()
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        schema = ", ".join(f"{c} string" for c in partition_cols)
        return spark.createDataFrame([], schema)


def write_if_absent(df: DataFrame, path: str, partition_cols, force: bool = False) -> DataFrame:
    """Skip partitions that already exist unless ``force``; returns the
    rows actually written.  The anti-join is on the (small) distinct
    partition keys, not on the rows."""
    cols = list(partition_cols)
    todo = df
    if not force and cols:
        have = existing_partitions(df.sparkSession, path, cols)
        have = have.select(*[F.col(c).cast(df.schema[c].dataType).alias(c) for c in cols])
        # Freeze the partition list (directory metadata, one row per
        # partition) before writing into the same folder, so the returned
        # frame does not change once the new partitions exist.
        frozen = df.sparkSession.createDataFrame(have.collect(), have.schema)
        todo = df.join(frozen, cols, "left_anti")
    write_partitioned(todo, path, cols, mode="overwrite" if force else "append")
    return todo


def write_dlq(failed: DataFrame, path: str, partition_cols) -> None:
    """Failed records (JSON record + error list) as JSON Lines."""
    failed.write.mode("append").partitionBy(*partition_cols).json(path)


def write_document(df: DataFrame, path: str) -> None:
    """A small curated document as JSON (one file: the document is one
    row by construction, so no data funnels through a single task)."""
    df.coalesce(1).write.mode("overwrite").json(path)
