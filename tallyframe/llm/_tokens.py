"""Exact, cached encoding of texts with a public ``tokenizers`` file.

The tokenizer splits at white space before it merges, so a text's ids are the
ids of its space- or line-separated chunks in order.  Each Python worker keeps
the ids of the chunks it has met; only new chunks go to the library.
"""

from __future__ import annotations

import os
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tallyframe.llm._text import runs

END_ID = 1
# Chunks kept by one Python worker; beyond it those met once or twice go.
CACHE_CHUNKS = 700_000
_SLICE_BYTES = 1 << 22
# Chunks of these characters alone are cut before they are learnt: none of them
# joins a neighbour when normalised.
_PLAIN = re.compile(r"[\x21-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
# How the tokenizer cuts such a chunk in lower case: fixed by its file.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^\sa-z0-9\xdf-\xf6\xf8-\xff]+")


def default_tokenizer() -> str:
    """Path of the public tokenizer file, looked up where the code runs."""
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids of texts, equal to ``Tokenizer.encode(text, add_special_tokens=False)``."""

    def __init__(self, path: str | None = None, cache_chunks: int = CACHE_CHUNKS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self._tok = Tokenizer.from_file(path or default_tokenizer())
        self._max = cache_chunks
        vocab = self._tok.get_vocab(with_added_tokens=True)
        self._ends_word = np.zeros(max(vocab.values()) + 1, bool)
        self._ends_word[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        self._at: dict[str, int] = {}
        self._ids = np.zeros(1 << 16, np.uint32)
        self._used = 0
        self._lens = np.zeros(1 << 14, np.int64)
        self._starts = np.zeros(1 << 14, np.int64)
        self._met = np.zeros(1 << 14, np.int32)

    def _thin_out(self, room: int) -> None:
        """Keep the chunks met most often, so that ``room`` more fit."""
        words = list(self._at)
        often = np.flatnonzero(self._met[:len(words)] > 2)
        if len(often) + room > self._max:
            return self._clear()
        ids, lens = self._gather(often)
        self._clear()
        self._put([words[i] for i in often.tolist()], lens, ids)

    def _grow(self, n_ids: int, n_words: int) -> None:
        if self._used + n_ids > len(self._ids):
            self._ids = np.resize(self._ids, 2 * (self._used + n_ids))
        if len(self._at) + n_words > len(self._lens):
            n = 2 * (len(self._at) + n_words)
            self._lens, self._starts = np.resize(self._lens, n), np.resize(self._starts, n)
            self._met = np.concatenate([self._met, np.zeros(n - len(self._met), np.int32)])

    def _put(self, words: list[str], lens: np.ndarray, ids: np.ndarray) -> None:
        self._grow(len(ids), len(words))
        k = len(self._at)
        self._lens[k:k + len(words)] = lens
        self._starts[k:k + len(words)] = self._used + np.cumsum(lens) - lens
        self._ids[self._used:self._used + len(ids)] = ids
        self._used += len(ids)
        self._at.update(zip(words, range(k, k + len(words))))

    def _gather(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the known chunks ``which`` in order, and each one's count."""
        lens = self._lens[which]
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        return self._ids[np.repeat(self._starts[which] - ends + lens, lens) + np.arange(total)], lens

    def _put_each(self, words: list[str]) -> None:
        ids = [e.ids for e in self._tok.encode_batch_fast(words, add_special_tokens=False)]
        self._put(words, np.fromiter(map(len, ids), np.int64, len(ids)),
                  np.fromiter((x for e in ids for x in e), np.uint32))

    def _put_letters(self, words: list[str]) -> None:
        """Words of letters only: each is one pre-token and so closes with the
        one id that ends a word, which tells the words of one call apart."""
        ids = np.asarray(self._tok.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        close = np.flatnonzero(self._ends_word[ids])
        if len(close) != len(words):  # a letter that normalises to more than letters
            return self._put_each(words)
        self._put(words, np.diff(close, prepend=-1), ids)

    def _learn(self, words: list[str]) -> None:
        letters, odd, plain, flat, counts = [], [], [], [], []
        for w in words:
            if w.isalpha():
                letters.append(w)
            elif "<" not in w and _PLAIN.fullmatch(w):
                found = _PIECES.findall(w.lower())
                plain.append(w)
                flat += found
                counts.append(len(found))
            else:
                odd.append(w)
        pieces = set(flat).difference(letters) - self._at.keys()
        letters += [p for p in pieces if p.isalpha()]
        odd += [p for p in pieces if not p.isalpha()]
        for i in range(0, len(letters), 5_000):
            self._put_letters(letters[i:i + 5_000])
        for i in range(0, len(odd), 5_000):
            self._put_each(odd[i:i + 5_000])
        if plain:  # one made of a single piece is known by now and gets the same ids
            n = np.asarray(counts)
            ids, lens = self._gather(np.fromiter(map(self._at.__getitem__, flat), np.int64, len(flat)))
            fresh = [w not in self._at for w in plain]
            keep = np.asarray(fresh)
            ids = ids[np.repeat(np.repeat(keep, n), lens)]
            self._put([w for w, f in zip(plain, fresh) if f], np.add.reduceat(lens, np.cumsum(n) - n)[keep], ids)

    def encode(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one end id after each, and each text's offset
        in them (one more entry at the end)."""
        col = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        out, counts = [], []
        for lo, hi in runs(col, _SLICE_BYTES):
            ids, n = self._slice(col.slice(lo, hi - lo))
            out.append(ids)
            counts.append(n)
        off = np.zeros(len(col) + 1, np.int64)
        if not out:
            return np.zeros(0, np.uint32), off
        np.cumsum(np.concatenate(counts), out=off[1:])
        return (out[0] if len(out) == 1 else np.concatenate(out)), off

    def _known(self, words: list[str]) -> np.ndarray:
        """Places of the chunks in the cache, -1 for those not in it."""
        return np.fromiter(map(self._at.get, words, repeat(-1)), np.int64, len(words))

    def _slice(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        # "<|" may start a special token, whose letters must stay as they are.
        # A-Z are lower-cased; other letters are left to the tokenizer.
        lower = pc.if_else(pc.match_substring(col, "<|"), col, pc.ascii_lower(col))
        chunks = pc.split_pattern(pc.replace_substring(lower, "\n", " "), " ")
        off = np.asarray(chunks.offsets)
        coded = chunks.flatten().dictionary_encode()
        words, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        # The end id closes each text: as a chunk of its own, the empty one.
        if "" not in self._at:
            self._put([""], np.ones(1, np.int64), np.asarray([END_ID], np.uint32))
        known = self._known(words)
        fresh = np.flatnonzero(known < 0)
        if len(self._at) + len(fresh) > self._max:
            self._thin_out(len(fresh))
            if "" not in self._at:
                self._put([""], np.ones(1, np.int64), np.asarray([END_ID], np.uint32))
            known = self._known(words)
            fresh = np.flatnonzero(known < 0)
        if len(fresh):
            new = [words[i] for i in fresh.tolist()]
            self._learn(new)
            known[fresh] = self._known(new)
        end = self._at[""]
        # Chunks between separators that follow each other are empty and go.
        which = known[code]
        full = which != end
        n_chunks = np.concatenate([[0], np.cumsum(full)])[off - off[0]]
        which = np.insert(which[full], n_chunks[1:], end)
        self._met[:len(self._at)] += np.bincount(which, minlength=len(self._at)).astype(np.int32)
        ids, lens = self._gather(which)
        close = n_chunks[1:] + np.arange(len(col))
        return ids, np.diff(np.cumsum(lens)[close], prepend=0)


def _ascii_lower(t: str) -> str:
    """A-Z lower-cased; other letters stay."""
    return t.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """This Python worker's encoder for the file."""
    key = path or ""
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path)
    return _ENCODERS[key]
