"""Hard negatives by exact integer scores from residue matrix products.

Vectors are scaled to integers.  A score is the inner product of two of them;
it is computed modulo several small primes by float32 matrix products, which
are exact because residues are centred and a product of ``CHUNK_DIMS``
dimensions stays below 2^24, and rebuilt as a signed integer by Chinese
remaindering.  The number of primes follows from the largest component.

Anchors and rows meet in tiles: every tile holds a bounded number of anchors
and of rows and keeps, per anchor, only its first candidates, so no task holds
a whole label and no pair of rows leaves a tile unless it is among a tile's
first.  Two passes: rows of the anchor's label give its positives, all rows
give the negatives whose score lies in a window set by each positive.

Defined cases: rows with a null label, a null vector or a null or non-finite
component take no part; a row without ``vec_id`` is no anchor and comes last
among equal scores; shorter vectors count as filled up with zeros; repeated
rows are rows of their own (two anchors with one ``vec_id`` both give their
lists); other columns are ignored, also ones with the names used here; empty
tables give empty results.  Scores that can reach 2^52 are an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.session import scratch_path

CHUNK_DIMS = 256
# Primes stay below this bound: (PRIME_BOUND / 2)^2 * CHUNK_DIMS <= 2^24.
PRIME_BOUND = 512
TILE_ROWS = (1 << 10, 1 << 16)
TILE_ANCHORS = 1 << 12
# Scores that a task holds at a time.
SLICE_SCORES = 1 << 21


def primes_for(bound: int) -> list[int]:
    """Largest primes below ``PRIME_BOUND`` whose product exceeds 2 * bound."""
    if bound >= 1 << 52:  # the product of the primes must fit 62 bits
        raise ValueError(f"scores up to {bound} are not smaller than 2^52")
    out, product = [], 1
    for n in range(PRIME_BOUND - 1, 2, -1):
        if product > 2 * bound:
            break
        if all(n % k for k in range(2, int(n ** 0.5) + 1)):
            out.append(n)
            product *= n
    return out


def residues(x: np.ndarray, p: int) -> np.ndarray:
    """x modulo p, between -(p-1)/2 and (p-1)/2, as float32."""
    half = p // 2
    return ((x + half) % p - half).astype(np.float32)


def exact_scores(a: np.ndarray, b: np.ndarray, primes: list[int]) -> np.ndarray:
    """Exact int64 ``a @ b.T`` of integer matrices whose entries are smaller
    than half the product of the primes."""
    total, weight = np.zeros((len(a), len(b)), np.int64), 1
    for k, p in enumerate(primes):
        product = np.zeros((len(a), len(b)), np.int64)
        ra, rb = residues(a, p), residues(b, p)
        for lo in range(0, a.shape[1], CHUNK_DIMS):
            product += (ra[:, lo:lo + CHUNK_DIMS] @ rb[:, lo:lo + CHUNK_DIMS].T).astype(np.int64)
        # Mixed-radix digit of this prime: what the digits before leave over.
        product -= total
        product %= p
        product *= pow(weight, -1, p) if k else 1
        product %= p
        product *= weight
        total += product
        weight *= p
    total[total > weight // 2] -= weight
    return total


def integer_rows(vectors: DataFrame, scale: int = 256, vector: str = "embedding") -> DataFrame:
    """``vec_id``, ``label`` and ``comps`` (floor(scale * component)) of the
    rows that take part; every seventh ``vec_id`` moves to the next label."""
    parts = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.when(F.pmod("vec_id", F.lit(7)) == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return (vectors.where(F.col("label").isNotNull() & F.col(vector).isNotNull() & finite)
            .select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"),
                    F.transform(parts, lambda x: F.floor(x * float(scale))).alias("comps")))


def _matrix(lists: pa.ChunkedArray, dims: int) -> np.ndarray:
    """Integer lists as rows of a matrix, filled up with zeros."""
    col = lists.combine_chunks()
    n = np.asarray(col.value_lengths(), np.int64)
    out = np.zeros((len(n), dims), np.int64)
    out[np.arange(dims)[None, :] < n[:, None]] = np.asarray(col.flatten(), np.int64)
    return out


def _tiles(rows: DataFrame, anchors: DataFrame, group: str | None, n_rows: DataFrame | int,
           n_anchors: DataFrame | int, per_row: int):
    """Rows and anchors, each sent to the tiles in which it meets the others.

    A group of r rows and a anchors has ceil(r / rows per tile) times
    ceil(a / anchors per tile) tiles; a row's block is a hash of its number.
    """
    blocks = lambda n, size: F.ceil(n / size).cast("long")
    rb, ab = blocks(F.col("_rows"), per_row), blocks(F.col("_anchors"), TILE_ANCHORS)
    own = lambda n: F.pmod(F.xxhash64("row"), n)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    g = F.col(group) if group else F.lit(0).cast("long")

    def sized(df):
        if group:
            return df.join(n_rows, group)
        return df.withColumn("_rows", F.lit(n_rows)).withColumn("_anchors", F.lit(n_anchors))

    left = sized(anchors).withColumn("g", g).withColumn("ab", own(ab)).withColumn("rb", every(rb)).drop("_rows", "_anchors")
    right = sized(rows).withColumn("g", g).withColumn("rb", own(rb)).withColumn("ab", every(ab)).drop("_rows", "_anchors")
    return left, right


def _firsts(scores: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k largest scores, ties by ``order`` (a rank without ties)."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((order[at], -scores[at]))[:k]]


def _by_id(table: pa.Table) -> np.ndarray:
    """Rank of each row by vec_id, nulls last, then by row number."""
    ids = table.column("vec_id").combine_chunks()
    none = np.asarray(ids.is_null())
    place = np.lexsort((np.asarray(table.column("row")), np.asarray(ids.fill_null(0)), none))
    rank = np.empty(len(place), np.int64)
    rank[place] = np.arange(len(place))
    return rank


def _slices(left: pa.Table, right: pa.Table, dims: int, primes: list[int]):
    """Anchor numbers and their scores with all rows of the tile."""
    a, b = _matrix(left.column("comps"), dims), _matrix(right.column("comps"), dims)
    step = max(1, SLICE_SCORES // max(len(b), 1))
    for lo in range(0, len(a), step):
        yield from enumerate(exact_scores(a[lo:lo + step], b, primes), lo)


def _take(table: pa.Table, name: str, at: list[np.ndarray]) -> pa.ChunkedArray:
    return table.column(name).take(pa.array(np.concatenate(at) if at else np.zeros(0, np.int64), pa.int64()))


def positives(rows: DataFrame, anchors: DataFrame, sizes: DataFrame, per_row: int, dims: int, primes: list[int],
              k: int = 5) -> DataFrame:
    """First k other rows of each anchor's label: ``anchor_row``, ``anchor_id``,
    ``positive_id``, ``positive_score``, ``place`` (from 1)."""
    left, right = _tiles(rows, anchors, "label", sizes, sizes, per_row)

    def first(a: pa.Table, r: pa.Table) -> pa.Table:
        rank, own, mine, theirs, score = _by_id(r), np.asarray(r.column("row")), [], [], []
        numbers = np.asarray(a.column("row")) if len(a) and len(r) else np.zeros(0, np.int64)
        for i, s in (_slices(a, r, dims, primes) if len(numbers) else ()):
            at = np.flatnonzero(own != numbers[i])
            at = at[_firsts(s[at], rank[at], k)]
            mine.append(np.full(len(at), i))
            theirs.append(at)
            score.append(s[at])
        return pa.table({"anchor_row": _take(a, "row", mine), "anchor_id": _take(a, "vec_id", mine),
                         "positive_row": _take(r, "row", theirs), "positive_id": _take(r, "vec_id", theirs),
                         "positive_score": np.concatenate(score) if score else np.zeros(0, np.int64)})

    near = (left.groupBy("g", "ab", "rb").cogroup(right.groupBy("g", "ab", "rb"))
            .applyInArrow(first, "anchor_row long, anchor_id long, positive_row long, positive_id long, "
                                 "positive_score long"))
    order = Window.partitionBy("anchor_row").orderBy(
        F.desc("positive_score"), F.asc_nulls_last("positive_id"), "positive_row")
    return near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("positive_row")


def negatives(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int, per_row: int, dims: int,
              primes: list[int], k: int = 10, window: tuple[int, int] = (30, 90)) -> DataFrame:
    """First k rows of other labels in the score window of each positive score
    in ``anchors.wanted``: ``anchor_row``, ``place`` (of the positive),
    ``negative_id``, ``negative_score``, ``rank``."""
    left, right = _tiles(rows, anchors, None, n_rows, n_anchors, per_row)
    low, high = window

    def first(a: pa.Table, r: pa.Table) -> pa.Table:
        mine, place, theirs, score = [], [], [], []
        if len(a) and len(r):
            rank, label = _by_id(r), np.asarray(r.column("label"))
            labels, wanted = np.asarray(a.column("label")), a.column("wanted").to_pylist()
            for i, s in _slices(a, r, dims, primes):
                other = np.flatnonzero(label != labels[i])
                s = s[other]
                for j, p in enumerate(wanted[i], 1):
                    # 100 * s lies between low * p and high * p, in whole numbers.
                    at = np.flatnonzero((s >= -(-low * p // 100)) & (s <= high * p // 100))
                    at = at[_firsts(s[at], rank[other[at]], k)]
                    mine.append(np.full(len(at), i))
                    place.append(np.full(len(at), j, np.int32))
                    theirs.append(other[at])
                    score.append(s[at])
        return pa.table({"anchor_row": _take(a, "row", mine),
                         "place": np.concatenate(place) if place else np.zeros(0, np.int32),
                         "negative_row": _take(r, "row", theirs), "negative_id": _take(r, "vec_id", theirs),
                         "negative_score": np.concatenate(score) if score else np.zeros(0, np.int64)})

    found = (left.groupBy("g", "ab", "rb").cogroup(right.groupBy("g", "ab", "rb"))
             .applyInArrow(first, "anchor_row long, place int, negative_row long, negative_id long, "
                                  "negative_score long"))
    order = Window.partitionBy("anchor_row", "place").orderBy(
        F.desc("negative_score"), F.asc_nulls_last("negative_id"), "negative_row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("negative_row")


def mine(vectors: DataFrame, every: int = 100, n_positives: int = 5, n_negatives: int = 10,
         window: tuple[int, int] = (30, 90), scale: int = 256, vector: str = "embedding") -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``,
    ``positive_score``, ``negative_score`` for all anchors (rows whose
    ``vec_id`` is divisible by ``every``).

    Rows are numbered once, in a written table, so a task that runs again
    sees the same numbers.
    """
    spark: SparkSession = vectors.sparkSession
    path = scratch_path(spark, "integer-vectors")
    (integer_rows(vectors, scale, vector).withColumn("row", F.monotonically_increasing_id()).write.parquet(path))
    rows = spark.read.parquet(path)
    is_anchor = F.coalesce(F.col("vec_id") % every == 0, F.lit(False))
    size = F.aggregate("comps", F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x.cast("double"))))
    n, n_anchors, dims, largest = rows.agg(
        F.count("*"), F.count_if(is_anchor), F.max(F.size("comps")), F.max(size)).first()
    dims = max(dims or 0, 1)
    primes = primes_for(dims * (int(largest or 0) + 1) ** 2)
    # Rows per tile grow with the table between fixed bounds.
    per_row = min(max(n // 256, TILE_ROWS[0]), TILE_ROWS[1])
    anchors = spark.read.parquet(path).where(is_anchor)  # read anew: a frame of its own beside rows
    sizes = rows.groupBy("label").agg(F.count("*").alias("_rows"), F.count_if(is_anchor).alias("_anchors")) \
        .where("_anchors > 0")
    path = scratch_path(spark, "positives")
    positives(rows, anchors, sizes, per_row, dims, primes, n_positives).write.parquet(path)
    pos = spark.read.parquet(path)
    wanted = pos.groupBy(F.col("anchor_row").alias("row")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "positive_score"))),
                    lambda x: x["positive_score"]).alias("wanted"))
    neg = negatives(rows, anchors.join(wanted, "row"), max(n, 1), max(n_anchors, 1), per_row, dims, primes, n_negatives, window)
    return (neg.join(pos, ["anchor_row", "place"])
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
