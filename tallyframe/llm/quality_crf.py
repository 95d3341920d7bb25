"""Quality rules with line labelling by a linear-chain conditional random field.

Every line with a word becomes one position of a chain, described by a few
bucketed features (length, symbols, capitals, marks, digits, repeats).  The
field's Viterbi path marks each line as content or boilerplate, and a
document is kept when content lines hold at least ``min_content`` of its
words, unless it already fails the base rules (too few words, or too many
repeated three-word windows).

The field is fitted on a bounded sample of labelled documents (``train_rows``,
chosen by hash of the id): lines of good documents count as content, lines of
bad ones as boilerplate, and the chain's transitions smooth what single lines
get wrong.  Fitting maximises the penalised likelihood by full-batch gradient
steps; its input is a few bytes a line.  Labelling runs over whole texts of
all documents, one pass without a shuffle.

Defined cases: a null or empty text has no words and is not kept; without
labelled documents of both kinds every line is content, so the base rules
decide alone; null ``doc_id`` and repeated rows are judged like any row;
columns of the input that clash with result columns are replaced in
``quality_measures`` and ignored by ``filter_quality``, which returns the
input's columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm._text import RUN_BYTES, Words, mix64, runs, span_hashes, text_bytes, text_column, windows

MIN_WORDS = 50
MIN_CONTENT = 0.5
TRAIN_ROWS = 4_000
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1
_LETTER = _UPPER.copy()
_LETTER[97:123] = 1
_DIGIT = np.zeros(256, np.int64)
_DIGIT[48:58] = 1
_SHOUT = np.zeros(256, np.int64)
_SHOUT[ord("!")] = 1
# Upper bounds of each feature's buckets; the last bucket is open.
_BUCKETS = {
    "words": (1, 3, 7, 15, 31), "symbols": (0, 0.1, 0.5), "capitals": (0.1, 0.3, 0.7), "marks": (0, 0.3),
    "digits": (0, 0.1), "closed": (0,), "repeat": (0,), "echo": (0, 0.3, 0.6), "word_length": (3, 6, 10),
}
_SIZES = [len(b) + 1 for b in _BUCKETS.values()]
_BASE = np.concatenate([[0], np.cumsum(_SIZES)])
N_FEATURES = int(_BASE[-1])


class Measures:
    """Measures of rows lo..hi of a text column and the features of their
    lines with a word (``feature``: one active index per bucketed feature)."""

    def __init__(self, col: pa.Array, lo: int, hi: int):
        data, off = text_bytes(col, lo, hi)
        n = hi - lo
        w = Words(data, off)
        rows = np.arange(n)
        self.n_words = np.diff(w.first)
        chars = _sums((data & 0xC0) != 0x80)
        word_chars = chars[w.end] - chars[w.start]
        self.word_chars = _by_doc(word_chars, w.first)
        symbols = _sums(_SYMBOL[data])
        self.n_symbols = symbols[off[1:]] - symbols[off[:-1]]

        # three-word windows that occur twice or more in their document
        hashes = span_hashes(data, w.start, w.end)
        h, at = windows(hashes, w.doc, 3)
        echoed = np.zeros(len(w.start), bool)
        if len(h):
            _, inv, count = np.unique(mix64(h ^ (w.doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))),
                                      return_inverse=True, return_counts=True)
            twice = at[count[inv] > 1]
            for j in range(3):
                echoed[twice + j] = True
        self.n_repeat_words = _by_doc(echoed.astype(np.int64), w.first)

        # lines
        breaks = np.flatnonzero(data == 10)
        start = np.sort(np.concatenate([off[:-1], breaks + 1]))
        end = np.sort(np.concatenate([breaks, off[1:]]))
        line_doc = np.repeat(rows, np.diff(np.searchsorted(breaks, off)) + 1)
        first = np.searchsorted(w.doc + np.searchsorted(breaks, w.start), np.arange(len(start) + 1))
        held = np.flatnonzero(np.diff(first) > 0)
        start, end, line_doc = start[held], end[held], line_doc[held]
        words = np.diff(first)[held]
        lh = mix64(span_hashes(data, start, end) ^ (line_doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        _, once = np.unique(lh, return_index=True)
        repeat = np.ones(len(held), np.int64)
        repeat[once] = 0
        self.line_first = np.searchsorted(line_doc, np.arange(n + 1))
        self.n_dup_lines = _by_doc(repeat, self.line_first)
        self.line_words, self.line_doc = words, line_doc
        if not len(held):
            self.feature = np.zeros((0, len(_SIZES)), np.uint8)
            return
        a, b = first[held], first[held + 1]
        n_chars = np.add.reduceat(word_chars, a)
        echo = _sums(echoed)
        letters, upper, digit, shout = (_sums(x[data]) for x in (_LETTER, _UPPER, _DIGIT, _SHOUT))
        closing = data[w.end[b - 1] - 1]
        values = {
            "words": words, "symbols": (symbols[end] - symbols[start]) / words,
            "capitals": (upper[end] - upper[start]) / np.maximum(letters[end] - letters[start], 1),
            "marks": (shout[end] - shout[start]) / words, "digits": (digit[end] - digit[start]) / n_chars,
            "closed": np.isin(closing, list(b".!?")), "repeat": repeat,
            "echo": (echo[b] - echo[a]) / words, "word_length": n_chars / words,
        }
        self.feature = np.stack([np.searchsorted(np.asarray(bound, float), np.asarray(values[k], float), "left")
                                 + base for (k, bound), base in zip(_BUCKETS.items(), _BASE)], 1).astype(np.uint8)


def _sums(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x) + 1, np.int64)
    np.cumsum(x, out=out[1:])
    return out


def _by_doc(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    s = _sums(values)
    return s[first[1:]] - s[first[:-1]]


class Field:
    """Linear-chain field over two labels: 0 content, 1 boilerplate."""

    def __init__(self, weight: np.ndarray | None = None, move: np.ndarray | None = None):
        self.weight = np.zeros((N_FEATURES, 2)) if weight is None else weight
        self.move = np.zeros((2, 2)) if move is None else move

    @staticmethod
    def _steps(first: np.ndarray):
        """Chains by descending length and, for each position, how many reach it."""
        length = np.diff(first)
        order = np.argsort(-length, kind="stable")
        longest = int(length[order[0]]) if len(order) else 0
        alive = np.searchsorted(-length[order], -np.arange(1, longest + 1), "right")
        return first[:-1][order], alive

    def viterbi(self, feature: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Best label of each line; ``first``: where each chain begins."""
        score = self.weight[feature].sum(1)
        base, alive = self._steps(first)
        back = np.zeros((len(feature), 2), np.int8)
        best = np.zeros((len(base), 2))
        for t, k in enumerate(alive.tolist()):
            at = base[:k] + t
            if t:
                via = best[:k, :, None] + self.move
                back[at] = via.argmax(1)
                best[:k] = via.max(1)
            best[:k] += score[at]
        label = np.zeros(len(feature), np.int8)
        state = best.argmax(1).astype(np.int8)
        for t in range(len(alive) - 1, -1, -1):
            k = int(alive[t])
            at = base[:k] + t
            label[at] = state[:k]
            if t:
                state[:k] = back[at, state[:k]]
        return label

    def _likelihood(self, feature, first, gold):
        """Log-likelihood and its gradients (forward-backward)."""
        score = self.weight[feature].sum(1)
        base, alive = self._steps(first)
        fwd, bwd = np.zeros_like(score), np.zeros_like(score)
        g_move, like = np.zeros((2, 2)), 0.0
        for t, k in enumerate(alive.tolist()):
            at = base[:k] + t
            fwd[at] = score[at] if not t else score[at] + np.logaddexp(
                fwd[at - 1, :1] + self.move[0], fwd[at - 1, 1:] + self.move[1])
        for t in range(len(alive) - 2, -1, -1):
            at = base[:int(alive[t + 1])] + t
            nxt = score[at + 1] + bwd[at + 1]
            bwd[at] = np.logaddexp(self.move[:, 0] + nxt[:, :1], self.move[:, 1] + nxt[:, 1:])
        z = np.logaddexp(*(fwd + bwd).T)
        node = np.exp(fwd + bwd - z[:, None])
        node_gold = np.eye(2)[gold]
        like = (score * node_gold).sum() - z[base[:int(alive[0])]].sum()
        inner = np.ones(len(feature), bool)
        inner[base[:int(alive[0])]] = False
        at = np.flatnonzero(inner)
        if len(at):
            edge = (fwd[at - 1][:, :, None] + self.move + (score[at] + bwd[at])[:, None, :]) - z[at][:, None, None]
            g_move = node_gold[at - 1].T @ node_gold[at] - np.exp(edge).sum(0)
            like += (self.move * (node_gold[at - 1].T @ node_gold[at])).sum()
        g_weight = np.zeros_like(self.weight)
        diff = node_gold - node
        for j in range(feature.shape[1]):
            for y in (0, 1):
                g_weight[:, y] += np.bincount(feature[:, j], weights=diff[:, y], minlength=N_FEATURES)
        return like, g_weight, g_move

    def fit(self, feature: np.ndarray, first: np.ndarray, gold: np.ndarray, steps: int = 80,
            rate: float = 0.15, penalty: float = 1.0) -> "Field":
        """Adam on the penalised likelihood, per line."""
        theta = np.concatenate([self.weight.ravel(), self.move.ravel()])
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for i in range(1, steps + 1):
            self.weight, self.move = theta[:-4].reshape(-1, 2), theta[-4:].reshape(2, 2)
            _, gw, gm = self._likelihood(feature, first, gold)
            g = (np.concatenate([gw.ravel(), gm.ravel()]) - penalty * theta) / len(feature)
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta = theta + rate * (m / (1 - 0.9 ** i)) / (np.sqrt(v / (1 - 0.999 ** i)) + 1e-9)
        return Field(theta[:-4].reshape(-1, 2), theta[-4:].reshape(2, 2))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """``text`` and ``_label`` of at most ``rows`` labelled documents, the same
    ones on each run (ordered by a hash of the id)."""
    picked = (labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
              .groupBy("doc_id").agg(F.max(label).cast("int").alias("_label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    # At most ``rows`` pairs of id and label are broadcast.
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")


def train_field(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Field:
    """The field fitted on a bounded sample; all zero without both kinds."""

    def task(batches):
        for b in batches:
            col = text_column(b)
            y = b.column("_label").to_numpy()
            for lo, hi in runs(col):
                m = Measures(col, lo, hi)
                cut = m.line_first.tolist()
                yield pa.RecordBatch.from_arrays([
                    pa.array(y[lo:hi].astype(np.int32)),
                    pa.array([m.feature[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:])], pa.binary())],
                    ["label", "lines"])

    got = (labelled_sample(docs, labels, "quality", train_rows).select("text", "_label")
           .mapInArrow(task, "label int, lines binary").toArrow().to_pydict())
    pairs = sorted((x, y) for y, x in zip(got["label"], got["lines"]) if x)
    if len({y for _, y in pairs}) < 2:
        return Field()
    feature = np.frombuffer(b"".join(x for x, _ in pairs), np.uint8).reshape(-1, len(_SIZES))
    n = np.asarray([len(x) // len(_SIZES) for x, _ in pairs])
    gold = np.repeat([1 - y for _, y in pairs], n)
    return Field().fit(feature, np.concatenate([[0], np.cumsum(n)]), gold)


_MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _judge(field: Field, min_words: int, min_content: float):
    def judge(col: pa.Array, lo: int, hi: int) -> dict[str, np.ndarray]:
        m = Measures(col, lo, hi)
        label = field.viterbi(m.feature, m.line_first)
        content = _by_doc(m.line_words * (label == 0), m.line_first)
        share = content / np.maximum(m.n_words, 1)
        failed = (m.n_words < min_words) | (100 * m.n_repeat_words > 50 * m.n_words)
        return {**{k: getattr(m, k) for k in _MEASURES}, "content_words": content, "base_failed": failed,
                "kept": ~failed & (share >= min_content)}
    return judge


def quality_measures(docs: DataFrame, field: Field, min_words: int = MIN_WORDS,
                     min_content: float = MIN_CONTENT) -> DataFrame:
    """Per document: the measures, ``content_words``, ``base_failed``, ``kept``."""
    judge = _judge(field, min_words, min_content)

    def task(batches):
        for b in batches:
            col = text_column(b)
            for lo, hi in runs(col):
                out = judge(col, lo, hi)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(lo, hi - lo), *map(pa.array, out.values())], ["doc_id", *out])

    return docs.select("doc_id", "text").mapInArrow(
        task, "doc_id long, " + ", ".join(f"{k} long" for k in [*_MEASURES, "content_words"])
              + ", base_failed boolean, kept boolean")


def filter_quality(docs: DataFrame, field: Field, min_words: int = MIN_WORDS,
                   min_content: float = MIN_CONTENT) -> DataFrame:
    """The documents that are kept, with their columns."""
    judge = _judge(field, min_words, min_content)

    def task(batches):
        for b in batches:
            col = text_column(b)
            # Whole rows pass through here beside the measures: runs of 1 MB take
            # about 100 MB of working memory, of 4 MB 350.
            for lo, hi in runs(col, RUN_BYTES // 4):
                yield b.slice(lo, hi - lo).filter(pa.array(judge(col, lo, hi)["kept"]))

    return docs.mapInArrow(task, docs.schema)
