"""Spelling variants of words by composition of finite-state machines.

The words of a group that share a prefix form an acceptor, minimised by
merging states with equal right languages; a chain of states without a branch
is one labelled edge.  Composed with the one-edit transducer and the acceptor
again, it accepts exactly the pairs of words that differ by one edit.  Only
states of two kinds matter: before the edit both sides are in the same state
``q``; the edit leaves ``q`` by two different letters, or by a letter on one
side alone; after it the pair of states reads what both accept.  The edit
stands at the first place where the words differ, so each pair is found once.

The composition is split by its initial state: words with a common prefix are
one initial state's partition.  A partition of more than ``GROUP_WORDS`` words
is not handed to a task.  Spark takes its first step: pairs whose edit lies at
the branching place have the same rest, so an equality on (place, rest) finds
them, in groups no larger than the alphabet; the pairs that agree there are in
the partitions of the prefixes longer by one letter, which are split again
until all are small.

Defined cases: a null text has no words; a null ``doc_id`` counts as the empty
text in the deletion rule; repeated rows count as often as they stand there;
other columns are ignored; an empty table gives an empty result.  Memory of a
task follows ``GROUP_WORDS`` times the length of its words.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import combinations, groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from tallyframe.llm._text import runs, text_column
from tallyframe.llm._tokens import _ascii_lower
from tallyframe.session import scratch_path

GROUP_WORDS = 1 << 14
# Distinct words that a counting task holds before it hands them on.
HELD_WORDS = 200_000
MIN_LETTERS = 5
MIN_COUNT = 3


def counted_words(docs: DataFrame, min_letters: int = MIN_LETTERS, delete_every: int | None = 97) -> DataFrame:
    """``word``, ``n``: lower-cased runs of letters of all texts, of at least
    ``min_letters``, with their counts.  A run of a document whose checksum
    ``delete_every`` divides has lost one letter (None: no such rule)."""
    run = re.compile("[a-zÀ-ÿ]{%d,}" % min_letters)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        get = held.get

        def full() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for b in batches:
            col, ids = text_column(b), b.column("doc_id").to_pylist()
            for lo, hi in runs(col):
                for doc_id, text in zip(ids[lo:hi], col.slice(lo, hi - lo).to_pylist()):
                    found = Counter(run.findall(_ascii_lower(text)))
                    if delete_every is None:
                        for w, n in found.items():
                            held[w] = get(w, 0) + n
                    else:
                        start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                        for w, n in found.items():
                            h = zlib.crc32(w.encode(), start)
                            if not h % delete_every:
                                at = h % len(w)
                                w = w[:at] + w[at + 1:]
                                if len(w) < min_letters:
                                    continue
                            held[w] = get(w, 0) + n
                    if len(held) > HELD_WORDS:
                        yield full()
        yield full()

    return (docs.select("doc_id", "text").mapInArrow(count, "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")))


def _shared(a: str, b: str) -> int:
    """Length of the common prefix."""
    hi = min(len(a), len(b))
    if a[:hi] == b[:hi]:
        return hi
    lo = 0
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


class Acceptor:
    """Minimal deterministic acceptor of sorted distinct words.

    ``edges[q]``: first letter -> (label, next state); ``final[q]``;
    ``lengths[q]``: bit i is set if q accepts a word of length i.
    """

    def __init__(self, words: list[str]):
        self.final: list[bool] = []
        self.edges: list[dict[str, tuple[str, int]]] = []
        self.lengths: list[int] = []
        self._known: dict[tuple, int] = {}
        open_: list[tuple[int, bool, list[tuple[str, int]]]] = [(0, bool(words) and words[0] == "", [])]
        last = ""
        for w in words:
            if w:
                self._close(open_, last, _shared(last, w))
                open_.append((len(w), True, []))
                last = w
        self._close(open_, last, 0)
        self.start = self._state(open_[0][1], open_[0][2])

    def _close(self, open_: list, word: str, depth: int) -> None:
        """Finish the open states of ``word`` below ``depth``."""
        while open_[-1][0] > depth:
            end, final, out = open_.pop()
            if open_[-1][0] < depth:
                open_.append((depth, False, []))
            open_[-1][2].append((word[open_[-1][0]:end], self._state(final, out)))

    def _state(self, final: bool, out: list[tuple[str, int]]) -> int:
        key = (final, *out)
        q = self._known.get(key)
        if q is None:
            q = self._known[key] = len(self.final)
            self.final.append(final)
            self.edges.append({label[0]: (label, to) for label, to in out})
            mask = int(final)
            for label, to in out:
                mask |= self.lengths[to] << len(label)
            self.lengths.append(mask)
        return q

    def common(self, a: str, p: int, b: str, q: int, without: str = "") -> Iterator[str]:
        """Words accepted both after ``a`` from state p and after ``b`` from q;
        the first letter ``without`` is not taken."""
        open_ = [("", a, p, b, q)]
        while open_:
            done, a, p, b, q = open_.pop()
            if not (self.lengths[p] << len(a)) & (self.lengths[q] << len(b)):
                continue
            n = min(len(a), len(b))
            if n:
                if a[:n] != b[:n] or (not done and a[0] == without):
                    continue
                done, a, b = done + a[:n], a[n:], b[n:]
            if a or b:
                rest, at = (a, q) if a else (b, p)
                if not done and rest[0] == without:
                    continue
                edge = self.edges[at].get(rest[0])
                if edge:
                    open_.append((done, a, p, *edge) if a else (done, *edge, b, q))
                continue
            if self.final[p] and self.final[q]:
                yield done
            other = self.edges[q]
            for c, edge in self.edges[p].items():
                if c in other and (done or c != without):
                    open_.append((done, *edge, *other[c]))

    def edited(self, q: int) -> list[tuple[str, str]]:
        """Pairs of words accepted from q that differ by one edit at its place."""
        out = []
        for (c, (a, p)), (d, (b, r)) in combinations(self.edges[q].items(), 2):
            out += [(c + s, d + s) for s in self.common(a[1:], p, b[1:], r)]
        for c, (a, p) in self.edges[q].items():
            out += [(c + s, s) for s in self.common(a[1:], p, "", q, without=c)]
        return out

    def near_pairs(self) -> Iterator[tuple[str, str]]:
        """All pairs of accepted words that differ by exactly one edit, once each."""
        known: dict[int, list[tuple[str, str]]] = {}
        open_ = [("", self.start)]
        while open_:
            done, q = open_.pop()
            if q not in known:
                known[q] = self.edited(q)
            for x, y in known[q]:
                yield done + x, done + y
            open_ += [(done + label, to) for label, to in self.edges[q].values()]


def _near_in_groups(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words within each prefix group; groups arrive whole and in order."""
    rows = ((p, w, n) for b in batches for p, w, n in zip(*(b.column(c).to_pylist() for c in ("prefix", "word", "n"))))
    out: dict[str, list] = {}
    for _, group in groupby(rows, key=lambda r: r[0]):
        n = {w: k for _, w, k in group}
        if len(n) > 1:
            for pair in Acceptor(list(n)).near_pairs():
                for u, v in (pair, pair[::-1]):
                    best = out.setdefault(u, [0, 0, ""])
                    best[0] += 1
                    if (-n[v], v) < (-best[1], best[2]):
                        best[1:] = n[v], v
        if len(out) > GROUP_WORDS:
            yield _near_batch(out)
            out = {}
    yield _near_batch(out)


def _near_batch(out: dict[str, list]) -> pa.RecordBatch:
    cols = list(zip(*out.values())) or [(), (), ()]
    return pa.RecordBatch.from_arrays(
        [pa.array(out.keys(), pa.string()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
         pa.array(cols[2], pa.string())], ["word", "n_near", "near_n", "near"])


@F.pandas_udf(IntegerType())
def _shared_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_shared(x, y) for x, y in zip(a, b)], dtype="int32")


def near_words(words: DataFrame, group_words: int | None = None) -> DataFrame:
    """``word``, ``n_near``, ``near``, ``near_n``: for every word with near
    words, their count and the one of largest n (ties: smallest word).

    ``words`` (``word``, ``n``, words distinct) should be a written table: it
    is read once for every time that the prefixes grow.
    """
    spark = words.sparkSession
    limit = group_words or GROUP_WORDS
    open_ = words.select("word", "n", F.lit("").alias("prefix"))
    small, steps = [], []
    while True:
        groups = (open_.groupBy("prefix").agg(F.count("*").alias("m"), F.min("word").alias("a"), F.max("word").alias("b"))
                  .where(F.col("m") > limit))
        hot = _written(spark, groups.select("prefix", _shared_udf("a", "b").alias("cut")), "hot-prefixes")
        if hot.isEmpty():
            small.append(open_)
            break
        # As many rows as groups of more than `limit` words; Spark chooses the join by their size.
        split = _written(spark, open_.join(hot, "prefix", "left"), "split-words")
        small.append(split.where("cut IS NULL").drop("cut"))
        large = split.where("cut IS NOT NULL")
        steps.append(large)
        open_ = large.where(F.length("word") > F.col("cut")).select(
            "word", "n", F.substring("word", F.lit(1), F.col("cut") + 1).alias("prefix"))
    leaves = small[0]
    for part in small[1:]:
        leaves = leaves.unionByName(part)
    found = (leaves.repartition("prefix").sortWithinPartitions("prefix", "word")
             .mapInArrow(_near_in_groups, "word string, n_near long, near_n long, near string"))
    for large in steps:
        found = found.unionByName(_first_step(large))
    return (found.groupBy("word").agg(F.sum("n_near").alias("n_near"),
                                      F.min(F.struct((-F.col("near_n")).alias("k"), "near")).alias("best"))
            .select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.k")).alias("near_n")))


def _first_step(large: DataFrame) -> DataFrame:
    """Near words whose edit lies at ``cut``, the branching place of their group.

    A word without its letter there, and a word as it is, meet in one list of
    at most the alphabet's size and one; those that differ at the place are near.
    """
    w, cut = F.col("word"), F.col("cut")
    letter = F.substring(w, cut + 1, F.lit(1))
    rest = F.concat(F.substring(w, F.lit(1), cut), F.substring(w, cut + 2, F.length(w)))
    rows = large.select("word", "n", "cut", letter.alias("c"), F.explode(
        F.when(F.length(w) > cut, F.array(rest, w)).otherwise(F.array(w))).alias("rest"))
    member = F.struct("word", "n", "c")
    lists = rows.groupBy("cut", "rest").agg(F.collect_list(member).alias("m")).where(F.size("m") > 1)
    one = lists.select("m", F.explode("m").alias("x"))
    return (one.select(F.col("x.word").alias("word"), F.filter("m", lambda y: y["c"] != F.col("x.c")).alias("others"))
            .where(F.size("others") > 0)
            .select("word", F.size("others").cast("long").alias("n_near"), F.array_min(F.transform(
                "others", lambda y: F.struct((-y["n"]).alias("k"), y["word"].alias("near")))).alias("best"))
            .select("word", "n_near", (-F.col("best.k")).alias("near_n"), F.col("best.near").alias("near")))


def _written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


def roots(forms: DataFrame, longest: int) -> DataFrame:
    """``word``, ``root``: where each chain of ``word`` -> ``form`` ends.  Chains
    have at most ``longest`` steps; each round doubles the steps taken."""
    spark = forms.sparkSession
    at = forms.select("word", F.col("form").alias("root"))
    for _ in range(max(0, math.ceil(math.log2(max(longest, 1))))):
        at = _written(spark, at, "roots")
        onward = at.select(F.col("word").alias("_from"), F.col("root").alias("_to"))
        at = at.join(onward, at["root"] == onward["_from"], "left").select(
            "word", F.coalesce("_to", "root").alias("root"))
    return at


def variants(docs: DataFrame, min_count: int = MIN_COUNT, min_letters: int = MIN_LETTERS, factor: int = 2,
             delete_every: int | None = 97) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form``, ``form_n``, ``root`` of all words
    that occur often enough.  A word's form is its near word of largest n
    (ties: smallest) if that n is at least ``factor`` times the word's."""
    spark = docs.sparkSession
    words = _written(spark, counted_words(docs, min_letters, delete_every).where(F.col("n") >= min_count), "words")
    near = words.join(near_words(words), "word", "left")
    is_form = F.col("near_n") >= factor * F.col("n")
    table = _written(spark, near.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n")), "variants")
    # Each step of a chain multiplies n by the factor.
    most = words.agg(F.max("n")).first()[0] or 1
    end = roots(table.where("form IS NOT NULL"), int(math.log(max(most / min_count, 1), factor)) + 1)
    return table.join(end, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
