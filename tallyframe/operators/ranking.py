"""Global order statistics without a single-partition sort.

``rank().over(Window.orderBy(x))`` plans ``Exchange SinglePartition``: every
row funnels through one task.  When the ranked value lives on a bounded grid
(a 1-dp score clipped to [0, 100] has at most 1001 values) the rank is a
histogram look-up instead: one partial aggregate, a running sum over <= 1001
rows, and a broadcast join of that (provably tiny) histogram.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.session import scratch_path


def min_rank_desc_bounded(df: DataFrame, value: str, out: str, group_cols=()) -> DataFrame:
    """Min-rank (ties share the lowest rank) of ``value`` descending, within
    optional groups.

    Only valid when ``value`` takes a bounded number of distinct values
    (scores rounded to 0.1); nulls get a null rank.  Without groups the
    histogram has <= 1001 rows and is broadcast; with groups it is joined
    back on (group, value) and sized by AQE.
    """
    g = list(group_cols)
    hist = df.where(F.col(value).isNotNull()).groupBy(*g, value).agg(F.count(F.lit(1)).alias("_n"))
    w = (Window.partitionBy(*g) if g else Window).orderBy(F.col(value).desc()) \
        .rowsBetween(Window.unboundedPreceding, -1)
    ranks = hist.select(*[F.col(c).alias(f"_g_{c}") for c in g], F.col(value).alias("_v"),
                        (F.coalesce(F.sum("_n").over(w), F.lit(0)) + 1).cast("bigint").alias(out))
    cond = df[value] == F.col("_v")
    for c in g:
        cond = cond & (df[c] == F.col(f"_g_{c}"))
    side = ranks if g else F.broadcast(ranks)
    return df.join(side, cond, "left").drop("_v", *[f"_g_{c}" for c in g])


def nth_smallest_bounded(df: DataFrame, value: str, nth_expr, group_cols=()) -> DataFrame:
    """Exact order statistic per group: the value at 0-based index ``nth_expr``
    (an expression of the group size ``_n``) in ascending order.

    Works on the (group, value) histogram, whose size is bounded by the
    number of distinct values, not by the rows: a running count over the
    histogram finds the first value whose cumulative count exceeds ``nth``.
    """
    g = list(group_cols)
    hist = df.where(F.col(value).isNotNull()).groupBy(*g, value).agg(F.count(F.lit(1)).alias("_c"))
    wg = Window.partitionBy(*g) if g else Window.partitionBy(F.lit(1))
    cum = (hist.withColumn("_cum", F.sum("_c").over(wg.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)))
               .withColumn("_n", F.sum("_c").over(wg)))
    sel = cum.where(F.col("_cum") > nth_expr)
    return sel.groupBy(*g).agg(F.min(value).alias(value))


def _numbered_pieces(df: DataFrame, key_cols, order_cols, num_partitions: int | None) -> DataFrame:
    """``df`` ranged by (key, order), each row with its piece ``_pid`` and a
    row number ``_mid`` ascending in that order within the piece.

    The numbered frame is written once to the shared folder.  Everything
    derived from it reads that one table, so pieces mean the same for rows
    and for totals: two plans over ``repartitionByRange`` would each sample
    their own bounds.
    """
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    s = df.repartitionByRange(n, *key_cols, *order_cols).sortWithinPartitions(*key_cols, *order_cols)
    t = s.select("*", F.spark_partition_id().alias("_pid"), F.monotonically_increasing_id().alias("_mid"))
    path = scratch_path(df.sparkSession, "ranged")
    t.write.parquet(path)
    return df.sparkSession.read.schema(t.schema).parquet(path)


def _with_piece_totals(rows: DataFrame, totals: DataFrame, key_cols) -> DataFrame:
    """Join each row to its (piece, key) total; a null key is a key."""
    small = totals.select(F.col("_pid").alias("_p"), *[F.col(c).alias(f"_k_{i}") for i, c in enumerate(key_cols)],
                          *[c for c in totals.columns if c != "_pid" and c not in key_cols])
    on = F.col("_pid") == F.col("_p")
    for i, c in enumerate(key_cols):
        on = on & F.col(c).eqNullSafe(F.col(f"_k_{i}"))
    return rows.join(small, on)


def position_within_key(df: DataFrame, key_cols, order_cols, out: str = "pos",
                        num_partitions: int | None = None) -> DataFrame:
    """0-based position of every row inside its key group, in ``order_cols``
    order, WITHOUT putting a whole key group into one task.

    ``repartitionByRange`` on (key, order) splits even a key holding a third
    of all rows across many range partitions; each partition is sorted and
    numbered once (``_numbered_pieces``), a small (piece, key) -> (first
    number, count) table gives every piece its offset inside the key, and
    the position is offset + local index.  ``row_number`` over
    ``partitionBy(key)`` would sort the hot key in a single task instead.
    """
    key_cols, order_cols = list(key_cols), list(order_cols)
    t = _numbered_pieces(df, key_cols, order_cols, num_partitions)
    stats = t.groupBy("_pid", *key_cols).agg(F.min("_mid").alias("_m0"), F.count(F.lit(1)).alias("_cnt"))
    w = Window.partitionBy(*key_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.select("_pid", *key_cols, "_m0", F.coalesce(F.sum("_cnt").over(w), F.lit(0)).alias("_off"))
    j = _with_piece_totals(t, stats, key_cols)
    keep = [F.col(f"`{c}`") for c in df.columns]
    return j.select(*keep, (F.col("_off") + F.col("_mid") - F.col("_m0")).alias(out))


def prefix_sum_within_key(df: DataFrame, key_cols, order_cols, value: str, out: str,
                          inclusive: bool = True, num_partitions: int | None = None) -> DataFrame:
    """Running sum of ``value`` inside each key group in ``order_cols`` order
    (inclusive or exclusive of the current row), skew-safe.

    Same shape as ``position_within_key``: range partitions split a hot key,
    a local running sum runs per (piece, key) (bounded by the partition
    size), and a small per-(piece, key) total table supplies each piece's
    offset.
    """
    key_cols, order_cols = list(key_cols), list(order_cols)
    t = _numbered_pieces(df, key_cols, order_cols, num_partitions)
    wl = Window.partitionBy("_pid", *key_cols).orderBy("_mid")
    frame = wl.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = t.select("*", F.sum(value).over(frame).alias("_loc"))
    tot = t.groupBy("_pid", *key_cols).agg(F.sum(value).alias("_tot"))
    wo = Window.partitionBy(*key_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select("_pid", *key_cols, F.sum("_tot").over(wo).alias("_off"))
    j = _with_piece_totals(local, offs, key_cols)
    run = F.coalesce(F.col("_off"), F.lit(0)) + F.coalesce(F.col("_loc"), F.lit(0))
    keep = [F.col(f"`{c}`") for c in df.columns]
    return j.select(*keep, run.alias(out))


def range_count_within_key(df: DataFrame, key_cols, ts_col: str, id_col: str, span, out: str = "n") -> DataFrame:
    """For every row, the number of rows of its key with ``ts`` in
    ``[ts - span, ts]`` (peers included) -- the value of
    ``count(*) OVER (PARTITION BY key ORDER BY ts RANGE BETWEEN span
    PRECEDING AND CURRENT ROW)`` -- without sorting a key group in one task.

    Each row contributes two probes, one just before ``ts - span`` and one
    just after ``ts``; a skew-safe exclusive running count of real rows at
    each probe (``prefix_sum_within_key``) gives the two boundaries, and the
    answer is their difference (one aggregate per row id)."""
    key_cols = list(key_cols)
    base = df.select(*key_cols, F.col(ts_col).alias("_ts"), F.col(id_col).alias("_id"))
    real = base.select(*key_cols, "_ts", F.lit(1).alias("_kind"), "_id", F.lit(1).alias("_real"))
    lo = base.select(*key_cols, (F.col("_ts") - F.lit(span)).alias("_ts"), F.lit(0).alias("_kind"), "_id",
                     F.lit(0).alias("_real"))
    hi = base.select(*key_cols, "_ts", F.lit(2).alias("_kind"), "_id", F.lit(0).alias("_real"))
    allr = real.unionByName(lo).unionByName(hi)
    pre = prefix_sum_within_key(allr, key_cols, ["_ts", "_kind", "_id"], "_real", "_before", inclusive=False)
    probes = pre.where(F.col("_kind") != 1).groupBy("_id").agg(
        (F.max(F.when(F.col("_kind") == 2, F.col("_before"))) - F.max(F.when(F.col("_kind") == 0, F.col("_before"))))
        .cast("bigint").alias(out))
    return df.join(probes.withColumnRenamed("_id", id_col), id_col, "inner")


def idle_pieces(df: DataFrame, key_cols, ts_col: str, tie_cols, gap, out: str = "_piece") -> DataFrame:
    """Number (from 1) the stretches of each key that lie more than ``gap``
    after the row before, WITHOUT putting a key's rows into one task.

    One numbered table by ranges of (key, time); a gap between two of its
    pieces shows in the small table of each piece's first and last time, all
    other gaps within a piece.
    """
    key_cols = list(key_cols)
    t = _numbered_pieces(df, key_cols, [ts_col, *tie_cols], None)
    inside = Window.partitionBy("_pid", *key_cols).orderBy("_mid")
    new = F.coalesce(F.col(ts_col) - F.lag(ts_col).over(inside) > gap, F.lit(False)).cast("long")
    local = t.withColumn("_new", new)
    stats = local.groupBy("_pid", *key_cols).agg(
        F.min(ts_col).alias("_t0"), F.max(ts_col).alias("_t1"), F.sum("_new").alias("_gaps"))
    pieces = Window.partitionBy(*key_cols).orderBy("_pid")
    first = F.coalesce(F.col("_t0") - F.lag("_t1").over(pieces) > gap, F.lit(True)).cast("long")
    stats = stats.withColumn("_first", first)
    before = F.sum(F.col("_gaps") + F.col("_first")).over(pieces.rowsBetween(Window.unboundedPreceding, -1))
    stats = stats.select("_pid", *key_cols, (F.coalesce(before, F.lit(0)) + F.col("_first")).alias("_off"))
    run = local.withColumn("_loc", F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    j = _with_piece_totals(run, stats, key_cols)
    return j.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_off") + F.col("_loc")).alias(out))
