"""Document fingerprints: a homomorphic multiset hash of paragraphs.

A paragraph (a line of the text) is hashed to a wide vector of two parts, and
a document's fingerprint is the sum of its paragraphs' vectors:

* ``EXACT`` lanes modulo 2^32, an extendable-output hash of the paragraph's
  bytes.  Sums are equal when the multisets of paragraphs are equal, in any
  order, and otherwise differ but for a negligible chance;
* ``LIKE`` lanes modulo 2^16: every 5-word shingle of the paragraph adds +1 or
  -1 to one hashed lane.  This part is linear too, and its dot products
  estimate how many shingles two documents share.

Paragraphs can be inserted or deleted by adding or subtracting their vectors
(``combine``), without the rest of the text.  ``likeness`` of two fingerprints
is 2<a,b> / (|a|^2 + |b|^2) of the second part, held to 0..1: the share of
common shingles, with a standard error of about 1/sqrt(LIKE) = 0.06.  It is 1
for equal fingerprints.  A lane wraps beyond 32,767 net occurrences, which
touches the estimate only, never equality.

``edited_pairs`` compares every document with an edited self and with its
neighbour.  Documents are dealt to ranges of ``doc_id`` by explicit bounds;
the first document of a range also goes, as a guest, to the range above, so
each range is a stream of consecutive documents: one exchange of the texts,
one row of look-ahead, no window over all rows.

Defined cases: a null text is the empty text; a null ``doc_id`` comes after
all others; rows with equal ``doc_id`` follow each other by descending text; a
single row is its own next document; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm._text import Words, mix64, runs, shingles, span_hashes, text_bytes, text_column

EXACT = 64
LIKE = 256


def vectors(col: pa.Array) -> np.ndarray:
    """Fingerprints of an array of large strings as rows of bytes."""
    out = np.empty((len(col), 4 * EXACT + 2 * LIKE), np.uint8)
    for lo, hi in runs(col):
        data, off = text_bytes(col, lo, hi)
        out[lo:hi, :4 * EXACT] = _exact_sums(data, off).view(np.uint8)
        out[lo:hi, 4 * EXACT:] = _like_sums(data, off).view(np.uint8)
    return out


def _exact_sums(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    raw = data.tobytes()
    known: dict[bytes, bytes] = {}  # lines repeat, within a text and between them
    blocks, first = [], [0]
    for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
        for line in raw[a:b].split(b"\n"):
            v = known.get(line)
            if v is None:
                v = known[line] = hashlib.shake_128(line).digest(4 * EXACT)
            blocks.append(v)
        first.append(len(blocks))
    sums = np.empty((len(off) - 1, EXACT), "<u4")
    for i, (a, b) in enumerate(zip(first[:-1], first[1:])):
        np.sum(np.frombuffer(b"".join(blocks[a:b]), "<u4").reshape(-1, EXACT), axis=0, dtype=np.uint32, out=sums[i])
    return sums


def _like_sums(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    n = len(off) - 1
    w = Words(data, off)
    breaks = np.flatnonzero(data == 10)
    line = w.doc + np.searchsorted(breaks, w.start)
    first = np.searchsorted(line, np.arange(n + len(breaks) + 1))
    h, own = shingles(w, span_hashes(data, w.start, w.end), line, first)
    if not len(h):
        return np.zeros((n, LIKE), "<i2")
    doc_of_line = np.repeat(np.arange(n), np.diff(np.searchsorted(breaks, off)) + 1)
    h = mix64(h)
    lane = doc_of_line[own] * LIKE + (h % np.uint64(LIKE)).astype(np.int64)
    sign = 1.0 - 2.0 * (h >> np.uint64(63)).astype(float)
    return np.bincount(lane, weights=sign, minlength=n * LIKE).astype(np.int64).astype("<i2").reshape(n, LIKE)


def combine(a: bytes, b: bytes, sign: int = 1) -> bytes:
    """Fingerprint of a with b's paragraphs added (``sign`` 1) or removed (-1)."""
    cut = 4 * EXACT
    s = np.uint32(sign & 0xFFFFFFFF)
    exact = np.frombuffer(a[:cut], "<u4") + s * np.frombuffer(b[:cut], "<u4")
    like = np.frombuffer(a[cut:], "<u2") + s.astype(np.uint16) * np.frombuffer(b[cut:], "<u2")
    return exact.astype("<u4").tobytes() + like.astype("<u2").tobytes()


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Likeness (0..1) of fingerprints, row by row."""
    x = np.ascontiguousarray(a[:, 4 * EXACT:]).view("<i2").astype(float)
    y = np.ascontiguousarray(b[:, 4 * EXACT:]).view("<i2").astype(float)
    norm = (x * x).sum(1) + (y * y).sum(1)
    out = np.clip(2 * (x * y).sum(1) / np.where(norm > 0, norm, 1), 0, 1)
    return np.where((a == b).all(1), 1.0, out)


def as_text(vectors_: np.ndarray) -> list[str]:
    return [base64.b64encode(v.tobytes()).decode() for v in vectors_]


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``fingerprint`` (base64) of every document."""

    def task(batches):
        for b in batches:
            col = text_column(b)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(as_text(vectors(col)), pa.string())],
                                             ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(task, "doc_id long, fingerprint string")


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by the following text's beginning."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def in_descending_streams(docs: DataFrame, ranges: int) -> DataFrame:
    """Rows dealt to contiguous ranges of ``doc_id`` and sorted descending in
    them; the last row of a range is a guest: the next document, which the
    range below owns (or, after the last document, the first).

    Adds ``_range`` and ``_guest``.  The bounds and the ranges' first ids are
    as many as there are ranges, whatever the table's size.
    """
    docs = docs.select("doc_id", "text")
    cuts = docs.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.25 / ranges) if ranges > 1 else []
    cuts = sorted(set(cuts))
    if cuts:
        split = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="_id", outputCol="_b",
                           handleInvalid="keep")
        dealt = split.transform(docs.withColumn("_id", F.coalesce(F.col("doc_id").cast("double"), F.lit(0.0))))
        dealt = dealt.withColumn("_b", F.col("_b").cast("int")).drop("_id")
    else:
        dealt = docs.withColumn("_b", F.lit(0))
    dealt = dealt.withColumn("_b", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(F.col("_b")))
    heads = sorted((r["_b"], r["head"]) for r in
                   dealt.groupBy("_b").agg(F.max("doc_id").alias("head")).collect())
    # The head of a range is the guest of the next range above that has rows.
    above = [(b, head, heads[(i + 1) % len(heads)][0]) for i, (b, head) in enumerate(heads)]
    spark = docs.sparkSession
    guests = F.broadcast(spark.createDataFrame(above, "_hb int, _head long, _to int"))
    is_head = (F.col("_b") == F.col("_hb")) & F.col("doc_id").eqNullSafe(F.col("_head"))
    places = F.array(F.struct(F.col("_b").alias("r"), F.lit(False).alias("g")))
    both = F.concat(places, F.array(F.struct(F.col("_to").alias("r"), F.lit(True).alias("g"))))
    return (dealt.join(guests, is_head, "left")
            .withColumn("_at", F.explode(F.when(F.col("_to").isNull(), places).otherwise(both)))
            .select("doc_id", "text", F.col("_at.r").alias("_range"), F.col("_at.g").alias("_guest"))
            .repartition(ranges, "_range")
            .sortWithinPartitions(F.col("_range").desc(), "_guest", F.col("doc_id").desc_nulls_last(),
                                  F.coalesce("text", F.lit("")).desc()))


def edited_pairs(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Per document: ``n_chars``, ``edited_sha256``, ``fingerprint``,
    ``edited_fingerprint``, ``near_edited`` and ``near_next``, the likeness to
    its edited text's and to the next document's fingerprint."""
    spark = docs.sparkSession
    if ranges is None:
        ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def task(batches):
        last = None  # look-ahead: the row before this slice, with its fingerprint
        for b in batches:
            whole = text_column(b)
            for lo, hi in runs(whole):
                col = whole.slice(lo, hi - lo)
                texts, prints = col.to_pylist(), vectors(col)
                ids = b.column("doc_id").slice(lo, hi - lo).to_pylist()
                place = list(zip(b.column("_range").slice(lo, hi - lo).to_pylist(),
                                 b.column("_guest").slice(lo, hi - lo).to_pylist()))
                if last is not None:
                    ids, texts, place = [last[0], *ids], [last[1], *texts], [last[2], *place]
                    prints = np.concatenate([last[3], prints])
                last = ids[-1], texts[-1], place[-1], prints[-1:]
                own = [i for i in range(len(ids) - 1) if not place[i][1]]
                if not own:
                    continue
                changed = [edited(texts[i], texts[i + 1]) for i in own]
                new = vectors(pa.array(changed, pa.large_string()))
                old, nxt = prints[own], prints[[i + 1 for i in own]]
                yield pa.RecordBatch.from_arrays([
                    pa.array([ids[i] for i in own], pa.int64()),
                    pa.array([len(texts[i]) for i in own], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
                    pa.array(as_text(old)), pa.array(as_text(new)),
                    pa.array(likeness(old, new)), pa.array(likeness(old, nxt))], names)

    return in_descending_streams(docs, ranges).mapInArrow(
        task, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double")
