"""Toxicity by a factorization machine over hashed terms.

A document is the set of its lower-case terms (runs of letters and digits),
each hashed to 64 bits.  The machine's score is

    bias + sum w_i + 1/2 * sum_f [ (sum v_if)^2 - sum v_if^2 ]

over the terms it knows: linear weights, and pairwise interactions through
the factors, so that two terms together can weigh more (or less) than their
sum, such as an insult beside the mention of a group.

Learning: a bounded, repeatable sample of labelled documents outside the
held-out fold.  The terms with the strongest association with the label
(log-likelihood gain, at most ``max_terms``), and those of the pairs with the
strongest association with what a machine of these leaves unexplained (again
at most ``max_terms``), form the hashed vocabulary: a term that tells nothing
alone is learnt if it does together with another.  All pairs of terms with
enough documents are compared, in blocks.  The model is at most
``2 * max_terms * (factors + 1)`` numbers whatever the corpus size, and is
shipped to the tasks with the scoring function.  Scoring reads whole texts of all
documents in one pass without a shuffle.

Defined cases: null and empty texts have no terms and score the bias alone; a
null ``doc_id`` is not held out; without both labels every score is 0; rows
repeat with their score; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm._text import LOWER, Words, runs, span_hashes, text_bytes, text_column

TRAIN_ROWS = 12_000
MAX_TERMS = 4_096
FACTORS = 8
PAIR_BLOCK = 1_024
MIN_DOCS = 4
_BREAK = np.ones(256, bool)
_BREAK[128:] = False
_BREAK[48:58] = False
_BREAK[65:91] = False
_BREAK[97:123] = False


def terms(col: pa.Array, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Term hashes of rows lo..hi and their rows (with repeats)."""
    data, off = text_bytes(col, lo, hi)
    data = LOWER[data]
    w = Words(data, off, _BREAK)
    return span_hashes(data, w.start, w.end), w.doc


class Machine:
    """Known term hashes (sorted), weights, factors and bias."""

    def __init__(self, known: np.ndarray, weight: np.ndarray, factor: np.ndarray, bias: float):
        self.known, self.weight, self.factor, self.bias = known, weight, factor, bias

    def active(self, h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (document, known term) pairs."""
        if not len(self.known) or not len(h):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        hit = self.known[at] == h
        pair = np.unique(doc[hit] * len(self.known) + at[hit])
        return pair // len(self.known), pair % len(self.known)

    def margin(self, doc: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        out = self.bias + np.bincount(doc, weights=self.weight[term], minlength=n)
        for f in range(self.factor.shape[1]):
            v = self.factor[term, f]
            s = np.bincount(doc, weights=v, minlength=n)
            out += 0.5 * (s * s - np.bincount(doc, weights=v * v, minlength=n))
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def distinct_pairs(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (term hash, document) pairs, ascending."""
    order = np.lexsort((doc, h))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], doc[new]


def gains(n: np.ndarray, pos: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Log-likelihood gain of the own rate ``pos / n`` over the rate ``p``."""
    rate = np.clip(pos / np.maximum(n, 1), 1e-12, 1 - 1e-12)
    p = np.clip(p, 1e-12, 1 - 1e-12)
    return n * (rate * np.log(rate / p) + (1 - rate) * np.log((1 - rate) / (1 - p)))


def choose_terms(h: np.ndarray, doc: np.ndarray, y: np.ndarray, max_terms: int, min_docs: int) -> np.ndarray:
    """The terms most associated with the label: by the log-likelihood gain of
    their own rate over the common one, and only those whose gain is beyond
    what the best of as many unrelated terms would show."""
    h, doc = distinct_pairs(h, doc)
    known, inv, n = np.unique(h, return_inverse=True, return_counts=True)
    pos = np.bincount(inv, weights=y[doc], minlength=len(known))
    gain = gains(n, pos, y.mean())
    often = n >= min_docs
    gain[~often] = 0
    best = np.lexsort((known, -gain))[:max_terms]
    return np.sort(known[best[gain[best] > np.log(max(often.sum(), 2))]])


def choose_pairs(h: np.ndarray, doc: np.ndarray, y: np.ndarray, p: np.ndarray, max_terms: int,
                 min_docs: int) -> np.ndarray:
    """The terms of the pairs most associated with what single terms leave
    unexplained (``p``: their probability for each document): by the gain of
    the rate where both occur over the expected one, and only those beyond
    what the best of as many unrelated pairs would show."""
    h, doc = distinct_pairs(h, doc)
    known, inv, n = np.unique(h, return_inverse=True, return_counts=True)
    often = n >= min_docs
    limit = np.log(max(often.sum() * (often.sum() - 1) / 2, 2))
    p = np.clip(p, 1e-6, 1 - 1e-6)
    # No pair can gain more than its positive documents, or all of them as negative ones, allow.
    each = -np.log(p.min())
    up = each * np.bincount(inv, weights=y[doc], minlength=len(known))
    down = np.bincount(inv, weights=-np.log1p(-p)[doc], minlength=len(known))
    able = np.flatnonzero(often & (np.maximum(up, down) > limit))
    able = able[np.argsort(-down[able], kind="stable")]  # the rare ones together: few of their pairs are possible
    down = down[able]
    place = np.full(len(known), -1)
    place[able] = np.arange(len(able))
    # positive documents first
    rank = np.empty(len(y), np.int64)
    rank[np.argsort(-y, kind="stable")] = np.arange(len(y))
    n_pos, p = int(y.sum()), p[np.argsort(-y, kind="stable")].astype(np.float32)
    at = place[inv]
    doc, at = rank[doc[at >= 0]], at[at >= 0]
    order = np.argsort(at, kind="stable")
    doc, at = doc[order], at[order]
    cut = np.searchsorted(at, np.arange(len(able) + 1))

    def block(lo, hi):
        out = np.zeros((len(y), hi - lo), np.float32)
        part = slice(cut[lo], cut[hi])
        out[doc[part], at[part] - lo] = 1
        return out

    best = np.zeros(len(able))
    for lo in range(0, len(able), PAIR_BLOCK):
        left = block(lo, min(lo + PAIR_BLOCK, len(able)))
        for low in range(lo, len(able), PAIR_BLOCK):
            right = left if low == lo else block(low, min(low + PAIR_BLOCK, len(able)))
            pos = left[:n_pos].T @ right[:n_pos]
            can = (pos * each > limit) | np.logical_and.outer(
                down[lo:lo + left.shape[1]] > limit, down[low:low + right.shape[1]] > limit)
            i, j = np.flatnonzero(can.any(axis=1)), np.flatnonzero(can.any(axis=0))
            if not len(i):
                continue
            some, other, pos = left[:, i], right[:, j], pos[np.ix_(i, j)]
            both, due = some.T @ other, (some * p[:, None]).T @ other
            # the gain is at most this chi-square, so few pairs need the logarithms
            a, z = np.nonzero((both >= min_docs) & ((pos - due) ** 2 * both > 0.99 * limit * due * (both - due)))
            a, z = (x[i[a] + lo != j[z] + low] for x in (a, z))
            b = both[a, z].astype(float)
            gain = gains(b, pos[a, z].astype(float), due[a, z] / b)
            np.maximum.at(best, i[a] + lo, gain)
            np.maximum.at(best, j[z] + low, gain)
    order = np.lexsort((known[able], -best))[:max_terms]
    return known[able[order[best[order] > limit]]]


def fit(h: np.ndarray, doc: np.ndarray, y: np.ndarray, max_terms: int = MAX_TERMS, factors: int = FACTORS,
        min_docs: int = MIN_DOCS, epochs: int = 30, rate: float = 0.1, penalty: float = 1e-3,
        batch: int = 256, seed: int = 7) -> Machine:
    """AdaGrad on the logistic loss over (term hash, document) pairs: with the
    terms that tell alone, then with those that tell in pairs too."""
    known = choose_terms(h, doc, y, max_terms, min_docs)
    m = descend(h, doc, y, known, factors, epochs, rate, penalty, batch, seed)
    # Labels are never as sure as a fitted machine is of its own rows.
    unsure = min(y.mean(), 1 - y.mean()) / 2
    p = np.clip(sigmoid(m.margin(*m.active(h, doc), len(y))), unsure, 1 - unsure)
    paired = np.setdiff1d(choose_pairs(h, doc, y, p, max_terms, min_docs), known)
    if not len(paired):
        return m
    return descend(h, doc, y, np.union1d(known, paired), factors, epochs, rate, penalty, batch, seed)


def descend(h, doc, y, known, factors, epochs, rate, penalty, batch, seed) -> Machine:
    """``fit`` for given terms."""
    rng = np.random.default_rng(seed)
    m = Machine(known, np.zeros(len(known)), rng.normal(0, 0.01, (len(known), factors)), 0.0)
    d, t = m.active(h, doc)
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    m.bias = float(np.log(p / (1 - p)))
    gw, gv, gb = np.full(len(known), 1e-6), np.full(m.factor.shape, 1e-6), 1e-6
    first = np.searchsorted(d, np.arange(len(y) + 1))
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), batch):
            rows = order[lo:lo + batch]
            n = first[rows + 1] - first[rows]
            own = np.repeat(np.arange(len(rows)), n)
            at = t[np.repeat(first[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            err = sigmoid(m.margin(own, at, len(rows))) - y[rows]
            g = err.mean()
            gb += g * g
            m.bias -= rate * g / np.sqrt(gb)
            if not len(at):
                continue
            touched, inv = np.unique(at, return_inverse=True)
            e = err[own] / len(rows)
            dw = np.bincount(inv, weights=e, minlength=len(touched)) + penalty * m.weight[touched] / len(rows)
            gw[touched] += dw * dw
            v = m.factor[at]
            dv = np.empty((len(touched), factors))
            for f in range(factors):
                s = np.bincount(own, weights=v[:, f], minlength=len(rows))
                dv[:, f] = np.bincount(inv, weights=e * (s[own] - v[:, f]), minlength=len(touched))
            dv += penalty * m.factor[touched] / len(rows)
            gv[touched] += dv * dv
            m.weight[touched] -= rate * dw / np.sqrt(gw[touched])
            m.factor[touched] -= 0.3 * rate * dv / np.sqrt(gv[touched])
    return m


def held_out(doc_id, folds: int = 5):
    """True for the fold that learning never sees: crc32 of the id's text mod
    ``folds`` is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, folds: int = 5, **settings) -> Machine:
    """Fit on at most ``train_rows`` labelled documents outside the held-out fold."""
    from tallyframe.llm.quality_crf import labelled_sample

    def task(batches):
        for b in batches:
            col = text_column(b)
            y = b.column("_label").to_numpy()
            for lo, hi in runs(col):
                h, doc = terms(col, lo, hi)
                cut = np.searchsorted(doc, np.arange(hi - lo + 1)).tolist()
                yield pa.RecordBatch.from_arrays([
                    b.column("doc_id").slice(lo, hi - lo), pa.array(y[lo:hi].astype(np.int32)),
                    pa.array([np.unique(h[i:j]).tobytes() for i, j in zip(cut[:-1], cut[1:])], pa.binary())],
                    ["doc_id", "label", "terms"])

    seen = labels.where(~held_out(F.col("doc_id"), folds))
    got = (labelled_sample(docs, seen, "toxic", train_rows)
           .mapInArrow(task, "doc_id long, label int, terms binary").toArrow().sort_by("doc_id").to_pydict())
    y = np.asarray(got["label"], float)
    if len(set(got["label"])) < 2:
        return Machine(np.zeros(0, np.uint64), np.zeros(0), np.zeros((0, 1)), -np.inf)
    n = [len(x) // 8 for x in got["terms"]]
    return fit(np.frombuffer(b"".join(got["terms"]), np.uint64), np.repeat(np.arange(len(y)), n), y, **settings)


def score(docs: DataFrame, machine: Machine, folds: int = 5, threshold: float = 0.5) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` (0 to 1), ``predicted`` of every document."""

    def task(batches):
        for b in batches:
            col = text_column(b)
            for lo, hi in runs(col):
                doc, term = machine.active(*terms(col, lo, hi))
                s = sigmoid(machine.margin(doc, term, hi - lo))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), pa.array(s)],
                                                 ["doc_id", "score"])

    out = docs.select("doc_id", "text").mapInArrow(task, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id"), folds).alias("held_out"), "score",
                      F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
