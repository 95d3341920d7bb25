"""N-gram Jaccard self-join with token-combination prefixes.

Documents are sets of 5-word shingles; two link when the sets' Jaccard
similarity is at least 75/100, compared in whole numbers.  Equal sets are one
*node*.

Tokens have a global order: rare tokens first, then frequent ones, each by
hash.  Nodes that link share at least ``k`` tokens among the first
``n - ceil(0.75 n) + k``, so candidates come from an inverted index over
prefixes: a rare token of the prefix is indexed alone, frequent tokens only
in pairs (sets too small for that index them alone as well).  Frequent tokens fall into ``FREQUENT_CLASSES`` hash classes, pairs
stay within a class, and the prefix is extended by one token for each class:
linked nodes that share no rare prefix token then share two frequent ones of
one class (by the pigeonhole), so no link can be missed.

Which tokens count as frequent never changes the result, only the work.  Each
task counts its tokens over the distinct sets it reads and reports those that
occur twice or more; the ``MAX_FREQUENT`` with the largest totals (at least
``MIN_COUNT``) are frequent.  So all documents count, and no exchange of all
tokens is needed.

From the index to links, without all pairs of a list:

1. every node of an index list is paired with the list's head (its smallest
   node) and with the node before it by size; pairs are verified, and
   verified links are joined to components;
2. lists whose nodes fall into more than one component give their pairs
   across components, of admissible sizes and with folded bitmaps that leave
   the threshold possible (tested in the join), each by the first list that
   both nodes are in, which are verified too.

Verifying drops the pairs whose token bitmaps already rule out the threshold
(an exact upper bound on the overlap) and compares the whole sets of the rest.

After step 2 every candidate pair is verified or lies within a component, so
components are exact; copies and near-copies are never expanded to all pairs.

Defined cases: null and empty texts (no words) have no shingles and link with
nothing; a text with fewer than five words is one shingle; a null ``doc_id``
is never the smallest of a component that has an id; repeated rows are equal
sets; an empty table gives an empty result; other columns are ignored.  A set
is identified by its size and a 64-bit digest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm._text import digest64, mix64, runs, shingle_sets, text_column
from tallyframe.llm.components import components
from tallyframe.session import scratch_path

NUM, DEN = 75, 100
FREQUENT_CLASSES = 16
MAX_FREQUENT = 1 << 18
MIN_COUNT = 24
LANES = 8  # words of a folded bitmap
FIRST = 16  # smallest signatures kept with a node
_COUNT_BLOCK = 2_000_000


def prefix_signatures(s: np.ndarray, frequent: np.ndarray, num: int = NUM, den: int = DEN) -> np.ndarray:
    """Signatures of a sorted set: rare prefix tokens, and same-class pairs of
    frequent prefix tokens.  A set whose overlap may be as small as the number
    of classes adds its frequent prefix tokens alone: two such sets meet there,
    and with a larger partner they share enough tokens for a pair."""
    n = len(s)
    need = n - (-(-num * n // den)) + 1
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
        often = frequent[at] == s
    else:
        often = np.zeros(n, bool)
    rare = s[~often]
    if len(rare) >= need:
        return rare[:need]
    hot = s[often]
    out = [rare]
    if n - need + 1 <= FREQUENT_CLASSES:  # too small for the pigeonhole among sets of its size
        out.append(mix64(hot[:need - len(rare)]))
    hot = hot[:need - len(rare) + FREQUENT_CLASSES]
    kind = hot % np.uint64(FREQUENT_CLASSES)
    for c in np.unique(kind):
        x = hot[kind == c]
        i, j = np.triu_indices(len(x), 1)
        out.append(mix64(x[i] * np.uint64(0x9E3779B97F4A7C15) + x[j]))
    return np.concatenate(out)


def bitmap(s: np.ndarray) -> np.ndarray:
    """Parities of a set's tokens over a power of two of at least two bits a
    token (and ``LANES`` words), as 64-bit words.  Two sets' bitmaps differ in at most as many bits
    as the sets differ in tokens; the larger one folds to the smaller's size."""
    bits = max(64 * LANES, 1 << (2 * len(s) - 1).bit_length())
    count = np.bincount((mix64(s) & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((count & 1).astype(np.uint8), bitorder="little").view(np.int64)


def node_key(s: np.ndarray) -> int:
    """Identity of a set: a digest of its hashes (their number included)."""
    return digest64(len(s).to_bytes(8, "little"), s.tobytes())


def _describe(shingle_words: int):
    """Rows of documents (``kind`` 0: id, size, key) and of tokens that repeat
    within the task (``kind`` 1: token, count)."""
    names = ["kind", "doc_id", "n_shingles", "key", "bits", "token", "seen"]
    words = pa.list_(pa.int64())

    def task(batches):
        held, size, known = [], 0, set()

        def counted():
            h, c = np.unique(np.concatenate(held), return_counts=True)
            h, c = h[c > 1], c[c > 1]
            k = len(h)
            return pa.RecordBatch.from_arrays([
                pa.array(np.ones(k, np.int8)), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()),
                pa.nulls(k, pa.int64()), pa.nulls(k, words), pa.array(h.view(np.int64)), pa.array(c)], names)

        for b in batches:
            col = text_column(b)
            for lo, hi in runs(col):
                sets = shingle_sets(col, lo, hi, shingle_words)
                keys = [node_key(s) if len(s) else None for s in sets]
                k = hi - lo
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.zeros(k, np.int8)), b.column("doc_id").slice(lo, k),
                    pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.int64()),
                    pa.array([bitmap(s) if len(s) else None for s in sets], words), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64())], names)
                for s, key in zip(sets, keys):
                    if key is not None and key not in known:  # copies count once
                        known.add(key)
                        held.append(s)
                        size += len(s)
                if size >= _COUNT_BLOCK:
                    yield counted()
                    held, size, known = [], 0, set()
        if held:
            yield counted()

    return task, ("kind byte, doc_id long, n_shingles long, key long, bits array<long>, "
                  "token long, seen long")


def _postings(frequent: np.ndarray, shingle_words: int):
    def task(batches):
        for b in batches:
            col = text_column(b)
            for lo, hi in runs(col):
                sig, key, size = [], [], []
                for s in {node_key(x): x for x in shingle_sets(col, lo, hi, shingle_words) if len(x)}.values():
                    g = prefix_signatures(s, frequent)
                    sig.append(g)
                    key.append(np.full(len(g), node_key(s), np.int64))
                    size.append(np.full(len(g), len(s), np.int32))
                if sig:
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.concatenate(sig).view(np.int64)), pa.array(np.concatenate(key)),
                        pa.array(np.concatenate(size))], ["sig", "key", "n"])
    return task


def _shared(batches):
    """From rows sorted by (sig, n, key): those whose signature two or more
    nodes hold, with the list's head and the node before.  One row is held
    over from batch to batch, whatever a list's length."""
    names = ["sig", "key", "n", "head", "head_n", "prev", "prev_n"]
    last = head = None  # last row (sig, key, n); head (key, n) of its list
    done = False  # whether the last row has been given out

    for b in batches:
        if not b.num_rows:
            continue
        sig, key, n = (b.column(i).to_numpy() for i in range(3))
        if last is not None:
            sig, key, n = (np.concatenate([[x], y]) for x, y in zip(last, (sig, key, n)))
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])  # else a set that was read twice
        sig, key, n = sig[new], key[new], n[new]
        first = np.ones(len(sig), bool)
        first[1:] = sig[1:] != sig[:-1]
        start = np.flatnonzero(first)
        length = np.diff(np.append(start, len(sig)))
        at_head = np.repeat(start, length)
        head_key, head_n = key[at_head], n[at_head]
        out = np.repeat(length, length) > 1
        if last is not None:
            head_key[:length[0]], head_n[:length[0]] = head
            out[:length[0]] |= done
            out[0] &= not done
        prev = np.where(first, at_head, np.arange(len(sig)) - 1)
        many = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (sig[many], key[many], n[many], head_key[many], head_n[many],
                                   key[prev[many]], n[prev[many]])], names)
        done = bool(out[-1]) or (len(sig) == 1 and done)
        last, head = (sig[-1], key[-1], n[-1]), (head_key[-1], head_n[-1])


def linked_documents(docs: DataFrame, shingle_words: int = 5) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` of every document."""
    spark = docs.sparkSession
    root = scratch_path(spark, "jaccard-join")

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{root}/{name}")
        return spark.read.parquet(f"{root}/{name}")

    texts = docs.select("doc_id", "text")
    task, schema = _describe(shingle_words)
    texts.mapInArrow(task, schema).write.partitionBy("kind").parquet(f"{root}/described")
    described = spark.read.schema(schema.replace("kind byte, ", "") + ", kind int").parquet(f"{root}/described")
    rows = described.where("kind = 0").select("doc_id", "n_shingles", "key")
    # At most MAX_FREQUENT hashes (2 MB) reach the driver and the tasks.
    top = (described.where("kind = 1").groupBy("token").agg(F.sum("seen").alias("seen"))
           .where(F.col("seen") >= MIN_COUNT).orderBy(F.col("seen").desc(), "token").limit(MAX_FREQUENT)
           .select("token").toArrow().column("token").to_numpy())
    frequent = np.sort(top.view(np.uint64))

    postings = texts.mapInArrow(_postings(frequent, shingle_words), "sig long, key long, n int")
    shared = stored(
        postings.repartition("sig").sortWithinPartitions("sig", "n", "key")
        .mapInArrow(_shared, "sig long, key long, n int, head long, head_n int, prev long, prev_n int"), "shared")
    near = shared.select("key", "n", F.explode(F.array(
        F.struct(F.col("head").alias("k"), F.col("head_n").alias("n")),
        F.struct(F.col("prev").alias("k"), F.col("prev_n").alias("n")))).alias("to"))
    pairs = _admissible(near.select(F.col("key").alias("a"), F.col("n").alias("an"),
                                    F.col("to.k").alias("b"), F.col("to.n").alias("bn")))
    marks = stored(described.where("kind = 0 and key is not null").groupBy("key")
                   .agg(F.first("bits").alias("bits"), F.first("n_shingles").alias("n"),
                        F.min("doc_id").alias("doc_id")), "marks")
    close = stored(_close(stored(pairs, "pairs-1"), marks), "close-1")
    links = stored(_verified(close, texts, marks, shingle_words), "links-1")
    comp = stored(components(links), "components-1")

    # Lists that hold more than one component: pairs across components.
    labelled = shared.select("sig", "key", "n").join(comp, F.col("key") == F.col("node"), "left").select(
        "sig", "key", "n", F.coalesce("root", "key").alias("root"))
    labelled = stored(labelled, "labelled")
    # Lists with the same members give the same pairs (documents that share a
    # passage share a list for each of its tokens): one of each such set stays.
    # Sets are told apart by size and two 64-bit digests.
    mixed = (labelled.groupBy("sig").agg(
        F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("size"),
        F.bit_xor(F.xxhash64("key")).alias("one"), F.bit_xor(F.xxhash64(F.lit(1), "key")).alias("two"))
        .where("lo <> hi").groupBy("size", "one", "two").agg(F.min("sig").alias("sig")))
    kept = stored(labelled.join(mixed.select("sig"), "sig", "left_semi"), "mixed")
    # A node's smallest signatures, by which a pair is given once only: at the
    # first list that both are in.
    low = kept.groupBy("key").agg(F.slice(F.sort_array(F.collect_list("sig")), 1, FIRST).alias("low"))
    lanes = marks.select("key", *[_lane(i).alias(f"lane{i}") for i in range(LANES)])
    node = lanes.join(low, "key").withColumnRenamed("key", "_k")
    left = stored(kept.join(node, F.col("key") == F.col("_k")).drop("_k")
                  .withColumn("low", F.filter("low", lambda s: s < F.col("sig"))), "sides")
    across = _across(left)
    tried = spark.read.parquet(f"{root}/pairs-1")
    fresh = stored(_admissible(across).join(tried, ["a", "b"], "left_anti"), "pairs-2")
    close = stored(_close(fresh, marks), "close-2")
    more = stored(_verified(close, texts, marks, shingle_words), "links-2")
    comp = components(links.union(more))

    low = (rows.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("first"))
           .join(comp, F.col("key") == F.col("node"), "left")
           .select("key", "first", F.coalesce("root", "key").alias("root")))
    low = stored(low, "nodes")
    least = low.groupBy("root").agg(F.min("first").alias("component_id"))
    label = low.join(least, "root").select(F.col("key").alias("_key"), "component_id")
    return (rows.join(stored(label, "labels"), F.col("key") == F.col("_key"), "left")
            .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")))


def keep_one(docs: DataFrame, shingle_words: int = 5) -> DataFrame:
    """One row of each component, with all columns: that of the smallest
    ``doc_id`` (null last), of rows alike in it the one of the smallest text
    digest and number.  Rows without any words are linked with nothing; of
    those alike in ``doc_id`` and text one stays.

    Rows are numbered in a written table and components found over the
    numbers, so repeated and null ids decide nothing but which row stays.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "numbered-documents")
    # The texts are written once, with a number for every row.
    docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                F.monotonically_increasing_id().alias("no")).write.parquet(path)
    rows = spark.read.parquet(path)
    found = linked_documents(rows.select(F.col("no").alias("doc_id"), F.col("row.text").alias("text")), shingle_words)
    found = found.select(F.col("doc_id").alias("no"), F.when(F.col("n_shingles") > 0, F.col("component_id")).alias("c"))
    ids = spark.read.parquet(path).select("no", F.col("row.doc_id").alias("id"), F.xxhash64("row.text").alias("text"))
    alone = lambda x: F.when(F.col("c").isNull(), F.col(x))  # noqa: E731 - only rows without words are told by id and text
    order = F.struct(F.col("id").isNull().alias("none"), "id", "text", "no")
    # A partial aggregate: a component of any size is one row a task.
    stays = (found.join(ids, "no").groupBy("c", alone("id").alias("i"), alone("text").alias("t"))
             .agg(F.min(order).alias("least")).select(F.col("least.no").alias("no")))
    return rows.join(stays, "no", "left_semi").select("row.*")


def _across(left: DataFrame) -> DataFrame:
    """Pairs of one list's nodes of different ``root``, of admissible sizes and
    with folded bitmaps that leave the threshold possible.

    ``low`` are those of the node's ``FIRST`` smallest signatures that are
    smaller than the row's.  If the two sides share one, the pair is given
    there, so it is given once; a pair whose first common signature is not
    among the smallest of both is given by every list that it shares, and
    never by none.
    """
    x, y = left.alias("x"), left.alias("y")
    apart = sum((F.bit_count(F.col(f"x.lane{i}").bitwiseXOR(F.col(f"y.lane{i}"))) for i in range(LANES)), F.lit(0))
    return x.join(y, (F.col("x.sig") == F.col("y.sig")) & (F.col("x.root") < F.col("y.root"))
                  & (DEN * F.least("x.n", "y.n") >= NUM * F.greatest("x.n", "y.n"))
                  & _possible(F.col("x.n"), F.col("y.n"), apart) & ~F.arrays_overlap("x.low", "y.low")).select(
        F.col("x.key").alias("a"), F.col("x.n").alias("an"), F.col("y.key").alias("b"), F.col("y.n").alias("bn"))


def _admissible(pairs: DataFrame) -> DataFrame:
    """Distinct pairs in one order whose sizes can reach the threshold."""
    ok = (F.col("a") != F.col("b")) & (DEN * F.least("an", "bn") >= NUM * F.greatest("an", "bn"))
    return pairs.where(ok).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _set_rows(shingle_words: int):
    def task(batches):
        for b in batches:
            col = text_column(b)
            for lo, hi in runs(col):
                found = {node_key(x): x for x in shingle_sets(col, lo, hi, shingle_words) if len(x)}
                off = np.concatenate([[0], np.cumsum([len(x) for x in found.values()])])
                values = np.concatenate(list(found.values())) if found else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([
                    pa.array(list(found), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(values.view(np.int64)))],
                    ["key", "tokens"])
    return task


def _lane(i: int) -> Column:
    """Word ``i`` of a bitmap folded to ``LANES`` words."""
    words = F.filter("bits", lambda _, at: at % LANES == i)
    return F.aggregate(words, F.lit(0).cast("long"), lambda t, w: t.bitwiseXOR(w))


def _possible(an: Column, bn: Column, apart: Column) -> Column:
    """Whether sets whose bitmaps differ in ``apart`` bits can be linked: they
    share at most (an + bn - apart) / 2 tokens."""
    return (DEN + NUM) * (an + bn - apart) >= 2 * NUM * (an + bn)


def _close(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """The pairs whose bitmaps leave the threshold possible.

    With d differing bits the sets differ in at least d tokens, so they share
    at most (an + bn - d) / 2.  The test never rejects a linked pair.
    """
    a = marks.select(F.col("key").alias("_a"), F.col("bits").alias("ab"), F.col("n").alias("an"))
    b = marks.select(F.col("key").alias("_b"), F.col("bits").alias("bb"), F.col("n").alias("bn"))

    def xor(x, y):
        return F.zip_with(x, y, lambda p, q: p.bitwiseXOR(q))

    def folded(x, y):  # sizes of admissible pairs differ by one power of two at most
        half = F.size(x) / 2
        half = half.cast("int")
        return F.when(F.size(x) > F.size(y), xor(F.slice(x, 1, half), F.slice(x, half + 1, half))).otherwise(x)
    apart = F.aggregate(xor(folded(F.col("ab"), F.col("bb")), folded(F.col("bb"), F.col("ab"))), F.lit(0),
                        lambda t, w: t + F.bit_count(w))
    return (pairs.join(a, F.col("a") == F.col("_a")).join(b, F.col("b") == F.col("_b"))
            .select("a", "b", "an", "bn", apart.alias("apart"))
            .where(_possible(F.col("an"), F.col("bn"), F.col("apart"))).select("a", "b"))


def _verified(pairs: DataFrame, texts: DataFrame, marks: DataFrame, shingle_words: int) -> DataFrame:
    """The pairs whose whole sets reach the threshold.  Sets are made of one
    document of each node; a set that is met twice gives the same link twice."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    chosen = marks.join(nodes, F.col("key") == F.col("node"), "left_semi").select(F.col("doc_id").alias("_id")).distinct()
    spark, root = pairs.sparkSession, scratch_path(pairs.sparkSession, "jaccard-sets")
    # Written first: its size is then known to the planner, which spares the
    # texts the exchange if the list of ids is short enough to broadcast.
    chosen.write.parquet(f"{root}/chosen")
    chosen = spark.read.parquet(f"{root}/chosen")
    texts.join(chosen, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").mapInArrow(
        _set_rows(shingle_words), "key long, tokens array<long>").write.parquet(f"{root}/sets")
    sets = spark.read.parquet(f"{root}/sets")
    a = sets.select(F.col("key").alias("_a"), F.col("tokens").alias("ta"))
    b = sets.select(F.col("key").alias("_b"), F.col("tokens").alias("tb"))
    both = F.size(F.array_intersect("ta", "tb"))
    return (pairs.join(a, F.col("a") == F.col("_a")).drop("_a").join(b, F.col("b") == F.col("_b"))
            .where(DEN * both >= NUM * (F.size("ta") + F.size("tb") - both)).select("a", "b"))
