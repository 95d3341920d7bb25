"""Session construction and shared-storage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job relies on.  AQE re-plans joins/partition counts at
# runtime and splits skewed shuffle partitions; UTC keeps month/day keys
# independent of the machine; the UI is a server and stays off.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "tallyframe", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the library's defaults.

    On a cluster pass ``master=None`` and let spark-submit decide; size
    ``shuffle_partitions`` to roughly input_bytes / 128 MB.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(_DEFAULTS)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names shared storage and is always read from
    the session.  Only when it is unset in a local session (unit tests, a
    laptop) do we set a private folder of our own; on a cluster, where other
    machines could not read it, that is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all machines share (master is {master})")
        d = tempfile.mkdtemp(prefix="tallyframe-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    try:
        spark.sparkContext.setCheckpointDir(d)
    except Exception:  # pragma: no cover - already set
        pass
    return d


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and materialised intermediate tables."""
    return ensure_checkpoint_dir(spark)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


# Parquet's writer by default looks at sizes after 100 rows, and keeps distinct
# values of 1 MB in all before it writes every row's value out in full.
_LONG_VALUES = {
    "parquet.page.size.row.check.min": "16",
    "parquet.block.size.row.check.min": "16",
    "parquet.dictionary.page.size": str(32 << 20),
}


def long_values(spark: SparkSession, column: str) -> None:
    """Have this session's Parquet writers take long values of ``column`` (a MB
    each and more) that neighbouring rows share: a value is written once for
    each file, by the dictionary, and a page holds 16 of them, not 100, where
    the dictionary is full.  Its least and greatest values are not kept (the
    footer leaves out long ones anyway).  What the session has set stays; the
    rows written are the same."""
    for k, v in {**_LONG_VALUES, f"parquet.column.statistics.enabled#{column}": "false"}.items():
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)


def is_local_path(path: str) -> bool:
    return "://" not in path or path.startswith("file:")


def local_dir(path: str) -> str:
    return path[len("file:"):] if path.startswith("file:") else path


def makedirs_if_local(path: str) -> None:
    if is_local_path(path):
        os.makedirs(local_dir(path), exist_ok=True)


def cluster_sizing(input_bytes: int, executors: int, cores_per_executor: int,
                   target_partition_bytes: int = 256 << 20) -> dict:
    """Settings for a cluster run over ``input_bytes`` of Parquet.

    Scan splits and shuffle partitions aim at ``target_partition_bytes``
    (256 MB: comfortably inside an executor core's share of memory even
    after decompression), never fewer than two waves of tasks; AQE then
    coalesces small shuffle partitions and splits skewed ones (a partition
    5x the median and over 1 GB is split).  At 100 TB this gives ~400k
    scan tasks and ~400k initial shuffle partitions, coalesced at runtime.
    """
    slots = max(1, executors * cores_per_executor)
    shuffle = max(2 * slots, int(input_bytes // target_partition_bytes))
    return {
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.shuffle.partitions": str(shuffle),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(1 << 30),
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
    }
