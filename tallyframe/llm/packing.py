"""Hierarchical multi-length packing of documents into training sequences.

A document is its token ids and an end id.  Documents are routed by length to
context-size tiers (256, 512, 1024, 2048 tokens by default), and each tier is
packed into windows of its own size:

1. every full longest window of a document is a sequence of its own;
2. what is left opens a window of the smallest tier that holds it, from the
   longest tier to the shortest;
3. the gap of such a window is filled from the shorter tiers: whole pieces
   first (the largest that fits), then one cut piece closes it;
4. once the shorter tiers are used up, the pieces left over are laid end to
   end in longest windows; only the last of these can be short.

All windows but that last one are full and their sizes powers of two, so a
packing group has less than one longest window of padding.  Sequences of a
tier are then dealt, by descending attention cost (sum of squared piece
lengths), back and forth over step groups of equal token counts.

A packing group is the documents of one Spark task, closed whenever it
reaches ``group_tokens``: one pass over the input, memory bounded by the
group, no key that can be hot, and a redone task gives the same pieces and
sequence ids.  Of a task's last group the one short window is not padded: its
pieces (below a longest window of ids a task) are packed again together with
those of as many tasks as make up ``group_tokens``.  So padding is below
``2048 / group_tokens`` of the ids, and one window more, however the input is
split into tasks.  The pieces are written to shared storage between the two
passes.

Defined cases: a null text is the empty text (its end id alone); null
``doc_id`` is carried through; repeated rows are packed as often as they
occur; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm._text import runs, text_column
from tallyframe.llm._tokens import encoder
from tallyframe.session import scratch_path

TIERS = (256, 512, 1024, 2048)
GROUP_TOKENS = 8_000_000
STEP_TOKENS = 64 * 2048


def plan_group(lengths: np.ndarray, tiers: tuple[int, ...] = TIERS,
               step_tokens: int = STEP_TOKENS) -> dict[str, np.ndarray]:
    """Pieces of one group: arrays ``doc`` (index), ``start``, ``length``,
    ``seq`` (from 0), ``offset``, ``tier`` and ``step`` (from 0)."""
    tiers = tuple(sorted(tiers))
    longest = tiers[-1]
    full = lengths // longest
    doc = np.repeat(np.arange(len(lengths)), full)
    start = (np.arange(len(doc)) - np.repeat(np.cumsum(full) - full, full)) * longest
    # Sequences as lists of (document, start, length).
    seqs: list[tuple[int, list[tuple[int, int, int]]]] = [
        (longest, [(d, s, longest)]) for d, s in zip(doc.tolist(), start.tolist())]

    rest = lengths - full * longest
    pieces = [(int(r), int(d), int(f) * longest) for d, (r, f) in enumerate(zip(rest, full)) if r]
    short = sorted(pieces)  # ascending by length; the longer tiers leave it first
    tail: list[tuple[int, int, int]] = []
    for t in range(len(tiers) - 1, -1, -1):
        size, below = tiers[t], tiers[t - 1] if t else 0
        cut = bisect_right(short, (below, 1 << 60, 0))
        own, short = short[cut:], short[:cut]
        if not t:  # the shortest tier fills its windows from itself
            own, short = [], own
            while short:
                own.append(short.pop())
                row, gap = [own[-1]], size - own[-1][0]
                if not _fill(row, gap, short):
                    tail += row
                else:
                    seqs.append((size, [(d, s, n) for n, d, s in row]))
            continue
        for piece in reversed(own):
            row = [piece]
            if _fill(row, size - piece[0], short):
                seqs.append((size, [(d, s, n) for n, d, s in row]))
            else:
                tail += row
    row, room = [], longest
    for n, d, s in tail:
        while n:
            take = min(n, room)
            row.append((d, s, take))
            n, s, room = n - take, s + take, room - take
            if not room:
                seqs.append((longest, row))
                row, room = [], longest
    if row:
        seqs.append((longest, row))
    return _laid_out(seqs, step_tokens)


def _fill(row: list, gap: int, short: list) -> bool:
    """Fill a gap with the shorter pieces (ascending): the largest that fits,
    again and again, then a cut one.  False if they run out (row keeps all)."""
    while gap:
        if not short:
            return False
        i = bisect_left(short, (gap + 1, -1, -1))
        if i:
            n, d, s = short.pop(i - 1)
            row.append((n, d, s))
            gap -= n
        else:  # all are longer than the gap: the shortest is cut
            n, d, s = short.pop(0)
            row.append((gap, d, s))
            insort(short, (n - gap, d, s + gap))
            gap = 0
    return True


def _laid_out(seqs: list, step_tokens: int) -> dict[str, np.ndarray]:
    count = np.fromiter((len(r) for _, r in seqs), np.int64, len(seqs))
    flat = np.asarray([p for _, r in seqs for p in r], np.int64).reshape(-1, 3)
    seq = np.repeat(np.arange(len(seqs)), count)
    ends = np.cumsum(flat[:, 2])
    first = (np.cumsum(count) - count)[seq]
    tier = np.fromiter((t for t, _ in seqs), np.int64, len(seqs))
    cost = np.bincount(seq, weights=flat[:, 2].astype(float) ** 2, minlength=len(seqs))
    step, used = np.zeros(len(seqs), np.int64), 0
    for size in np.unique(tier):
        at = np.flatnonzero(tier == size)
        at = at[np.argsort(-cost[at], kind="stable")]
        n = max(1, -(-len(at) * int(size) // step_tokens))
        lap, place = np.divmod(np.arange(len(at)), n)
        step[at] = used + np.where(lap % 2, n - 1 - place, place)
        used += n
    return {"doc": flat[:, 0], "start": flat[:, 1], "length": flat[:, 2], "seq": seq,
            "offset": ends - flat[:, 2] - (ends - flat[:, 2])[first], "tier": tier[seq], "step": step[seq]}


_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"]
_SCHEMA = ", ".join(f"{c} long" for c in _NAMES) + ", ids array<int>"
# Above the numbers of all tasks: sequences of the second pass.
_SECOND = 1 << 62


def _piece_rows(plan: dict[str, np.ndarray], doc_ids: pa.Array, ids: np.ndarray, off: np.ndarray, before: np.ndarray,
                doc_tokens: np.ndarray, seq0: int, step0: int, with_ids: np.ndarray) -> list[pa.Array]:
    """Columns of ``_SCHEMA``.  Of each packed item: its ids (between the
    offsets ``off``), how many of its document come ``before``, and the
    document's ``doc_tokens``.  ``with_ids``: the pieces that carry their ids."""
    doc, length = plan["doc"], plan["length"]
    lo = off[doc] + plan["start"]
    crc = [zlib.crc32(ids[a:b]) for a, b in zip(lo.tolist(), (lo + length).tolist())]
    n = np.where(with_ids, length, 0)
    ends = np.concatenate([[0], np.cumsum(n)])
    at = np.repeat(lo - ends[:-1], n) + np.arange(ends[-1])
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids[at].view(np.int32)),
                                     mask=pa.array(~with_ids))
    return [doc_ids.take(pa.array(doc)), pa.array(before[doc] + plan["start"]), pa.array(length),
            pa.array(crc, pa.int64()), pa.array(doc_tokens[doc]), pa.array(seq0 + plan["seq"]),
            pa.array(plan["offset"]), pa.array(plan["tier"]), pa.array(step0 + plan["step"]), lists]


def pack(docs: DataFrame, tokenizer: str | None = None, tiers: tuple[int, ...] = TIERS,
         group_tokens: int = GROUP_TOKENS, step_tokens: int = STEP_TOKENS, with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id``, ``start``, ``length``, ``ids_crc32``,
    ``doc_tokens``, ``sequence_id``, ``offset``, ``tier``, ``step_group``, and
    the piece's ``ids`` if asked for.  Sequence and step ids are unique over
    the whole result (the task's number in the high bits)."""

    def pack_task(batches):
        seq = step = TaskContext.get().partitionId() << 40
        held, tokens = [], 0

        def close(last):
            nonlocal seq, step
            n = np.concatenate([np.diff(o) for _, _, o in held])
            p = plan_group(n, tiers, step_tokens)
            short = np.bincount(p["seq"], weights=p["length"])[p["seq"]] < p["tier"]
            left = short if last else np.zeros(len(short), bool)
            out = _piece_rows(p, pa.concat_arrays([d for d, _, _ in held]),
                              np.concatenate([i for _, i, _ in held]).astype("<u4", copy=False),
                              np.concatenate([[0], np.cumsum(n)]), np.zeros(len(n), np.int64), n, seq, step,
                              left | with_ids)
            seq, step = seq + int(p["seq"].max()) + 1, step + int(p["step"].max()) + 1
            return pa.RecordBatch.from_arrays([*out, pa.array(left)], [*_NAMES, "ids", "left_over"])

        for b in batches:
            col = text_column(b)
            for lo, hi in runs(col):
                if tokens >= group_tokens:
                    yield close(False)
                    held, tokens = [], 0
                ids, off = encoder(tokenizer).encode(col.slice(lo, hi - lo))
                held.append((b.column("doc_id").slice(lo, hi - lo), ids, off))
                tokens += len(ids)
        if held:
            yield close(True)

    def pack_left(key, table):
        # The same order in a redone task, whichever way the rows arrive.
        table = table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")]).combine_chunks()
        n = table.column("length").to_numpy()
        base = _SECOND + (key[0].as_py() << 40)
        p = plan_group(n, tiers, step_tokens)
        ids = table.column("ids").combine_chunks().flatten().to_numpy().view("<u4")
        out = _piece_rows(p, table.column("doc_id").combine_chunks(), ids, np.concatenate([[0], np.cumsum(n)]),
                          table.column("start").to_numpy(), table.column("doc_tokens").to_numpy(), base, base,
                          np.full(len(p["doc"]), with_ids))
        return pa.Table.from_arrays(out, [*_NAMES, "ids"])

    spark = docs.sparkSession
    path = scratch_path(spark, "packed")
    docs.select("doc_id", "text").mapInArrow(pack_task, _SCHEMA + ", left_over boolean").write.parquet(path)
    pieces = spark.read.schema(_SCHEMA + ", left_over boolean").parquet(path)
    # A group of tasks leaves at most ``group_tokens`` ids.
    together = max(1, group_tokens // max(tiers))
    task = F.shiftright("sequence_id", 40)
    left = (pieces.where("left_over").drop("left_over")
            .groupBy(F.floor(task / together).cast("long").alias("tasks")).applyInArrow(pack_left, _SCHEMA))
    out = pieces.where("not left_over").drop("left_over").unionByName(left)
    return out if with_ids else out.drop("ids")
