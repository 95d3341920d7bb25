"""Byte-level BPE through a sentencepiece model written from the vocabulary.

A rank file lists byte strings with their merge order.  Every byte ``b`` is
mapped to the letter U+0100+b, so each byte string becomes a piece; a piece's
score is its negative rank, normalisation is the identity.  The model is
serialised here field by field and handed to sentencepiece, whose best-scored
merge, leftmost first, is then the lowest-ranked one.  The tokenizer's pattern
cuts a text into pre-tokens, which are encoded one by one; a pre-token that is
itself a piece is that piece.  Decoding maps the pieces back to bytes.

Each Python worker keeps the ids of the chunks (a word with the space before
it) that it has met; a chunk's ids do not depend on its surroundings.

Defined cases: a null or empty text has no ids and decodes to no bytes; rows
with equal or null ``doc_id`` each give a row; other columns of the input are
ignored; an empty table gives an empty result.  Long texts are cut at spaces,
so working memory follows the longest run without a space (about 150 bytes a
byte of a single pre-token, which is encoded whole).
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyframe.llm._text import RUN_BYTES, runs, text_column
from tallyframe.llm._tokens import Encoder

CACHE_CHUNKS = 500_000
SEGMENT_CHARS = 1 << 20
# Longer chunks are looked up by pre-token.
CHUNK_CHARS = 64

# White space of the pattern beside the space and the line feed.
_ASCII_WHITE = "\t\x0b\x0c\r"
_OTHER_WHITE = "".join(map(chr, (
    0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
# Letters and numbers younger than the Unicode tables (version 16)
# by which the rank files' library reads its pattern.
_YOUNG_LETTERS = (
    r"\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1"
    r"\uab6c-\uab6d\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee"
    r"\U00011b0a\U00011db0-\U00011ddb\U00011df1\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff3"
    r"\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191"
    r"\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81"
    r"\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5"
    r"\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e"
    r"\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f")
_YOUNG_NUMBERS = (r"\U00011de0-\U00011de9\U0001246f\U00012475-\U0001247f\U00012550-\U00012686"
                  r"\U00016ff4-\U00016ff6")


def default_ranks() -> str:
    """Path of the public rank file, looked up where the code runs."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def read_ranks(path: str) -> list[bytes]:
    """Byte strings of a rank file in ascending rank; ranks are 0, 1, 2 ..."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    pieces = [b""] * len(pairs)
    for text, rank in pairs:
        pieces[int(rank)] = base64.b64decode(text)
    if not all(pieces):
        raise ValueError("ranks must be 0, 1, 2 ... without gaps")
    return pieces


def to_letters(data: bytes) -> str:
    """Byte b as the letter U+0100+b."""
    wide = np.full(2 * len(data), 1, np.uint8)
    wide[::2] = np.frombuffer(data, np.uint8)
    return wide.tobytes().decode("utf-16-le")


def from_letters(text: str) -> bytes:
    """The inverse of ``to_letters``."""
    return text.encode("utf-16-le")[::2]


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def _int_field(no: int, value: int) -> bytes:
    return _varint(no << 3) + _varint(value)


def _bytes_field(no: int, value: bytes) -> bytes:
    return _varint(no << 3 | 2) + _varint(len(value)) + value


def model_proto(pieces: list[bytes]) -> bytes:
    """Serialised sentencepiece model: piece i scored -i, then the unknown piece."""
    # Field and enum numbers of sentencepiece's ModelProto.
    piece_type = {"normal": 1, "unknown": 2}

    def piece(text: str, score: float, kind: str) -> bytes:
        return _bytes_field(1, _bytes_field(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score)
                            + _int_field(3, piece_type[kind]))

    body = b"".join(piece(to_letters(p), -float(i), "normal") for i, p in enumerate(pieces))
    body += piece("<unk>", 0.0, "unknown")
    trainer = _int_field(3, 2) + _int_field(4, len(pieces) + 1) + _int_field(40, len(pieces))
    normalizer = _bytes_field(1, b"identity") + _int_field(3, 0) + _int_field(4, 0) + _int_field(5, 0)
    return body + _bytes_field(2, trainer) + _bytes_field(3, normalizer)


def _chunk(key: str) -> str:
    """The chunk that a cache key stands for."""
    return key[:-1] if key[-1] == " " else " " + key


class Codec(Encoder):
    """Ids of texts and texts of ids.  The chunk cache is ``Encoder``'s; a key
    without a space stands for the chunk after a space, ``chunk + " "`` for a
    chunk without one."""

    def __init__(self, path: str | None = None, cache_chunks: int = CACHE_CHUNKS):
        import public_tokenizers
        import regex
        import sentencepiece
        pieces = read_ranks(path or default_ranks())
        self._sp = sentencepiece.SentencePieceProcessor(model_proto=model_proto(pieces))
        self._rank = {p: i for i, p in enumerate(pieces)}
        self._max = cache_chunks
        self._pattern = regex.compile(public_tokenizers.PATTERN)
        old = (public_tokenizers.PATTERN
               .replace(r"[^\s\p{L}\p{N}]", r"[[^\s\p{L}\p{N}]||[" + _YOUNG_LETTERS + _YOUNG_NUMBERS + "]]")
               .replace(r"\p{L}+", r"[\p{L}--[" + _YOUNG_LETTERS + "]]+")
               .replace(r"\p{N}+", r"[\p{N}--[" + _YOUNG_NUMBERS + "]]+"))
        self._old_pattern = regex.compile(old, regex.V1)
        self._young = re.compile("[" + _YOUNG_LETTERS + _YOUNG_NUMBERS + "]")
        back = [from_letters(self._sp.id_to_piece(i)) for i in range(len(pieces))]
        self._flat = np.frombuffer(b"".join(back), np.uint8)
        self._size = np.fromiter(map(len, back), np.int64, len(back))
        self._at_byte = np.cumsum(self._size) - self._size
        self._clear()

    def pre_tokens(self, text: str) -> list[str]:
        """The pattern's matches, which cover the text."""
        if not text.isascii() and self._young.search(text):
            return self._old_pattern.findall(text)
        return self._pattern.findall(text)

    def _learn(self, keys: Iterable[str]) -> None:
        """Put the ids of new chunks into the cache: those of their new
        pre-tokens first, then those of chunks of several."""
        parts = {k: [k] if k.isalpha() and k.isascii() else self._word_keys(_chunk(k)) for k in keys}
        words = list({w for ws in parts.values() for w in ws if w not in self._at})
        for lo in range(0, len(words), 20_000):
            self._put_words(words[lo:lo + 20_000])
        parts = {k: ws for k, ws in parts.items() if k not in self._at}
        if parts:
            n = np.fromiter(map(len, parts.values()), np.int64, len(parts))
            ids, lens = self._gather(
                np.fromiter((self._at[w] for ws in parts.values() for w in ws), np.int64, int(n.sum())))
            self._put(list(parts), np.add.reduceat(lens, np.cumsum(n) - n), ids)

    def _put_words(self, words: list[str]) -> None:
        data = [_chunk(w).encode() for w in words]
        ids = [self._rank.get(b) for b in data]
        hard = [i for i, x in enumerate(ids) if x is None]
        ends = np.cumsum([len(data[i]) for i in hard]).tolist()
        text = to_letters(b"".join(data[i] for i in hard))
        found = iter(self._sp.encode([text[lo:hi] for lo, hi in zip([0, *ends[:-1]], ends)], num_threads=1))
        ids = [next(found) if x is None else (x,) for x in ids]
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        self._put(words, lens, np.fromiter(chain.from_iterable(ids), np.uint32, int(lens.sum())))

    def _keys(self, text: str) -> list[str]:
        """Cache keys whose chunks, in order, are the text."""
        white = _ASCII_WHITE if text.isascii() else _ASCII_WHITE + _OTHER_WHITE
        if (any(c in text for c in white) or "  " in text or " \n" in text or "\n\n\n" in text or "\n\n " in text
                or text.endswith((" ", "\n\n"))):
            return self._word_keys(text)
        out: list[str] = []
        for i, line in enumerate(text.split("\n")):
            if i:
                out.append("\n ")
            first, *rest = line.split(" ")
            if first:
                out.append(first + " ")
            out += rest
        if max(map(len, out), default=0) > CHUNK_CHARS:
            out = [k for key in out for k in (
                (key,) if len(key) <= CHUNK_CHARS else
                self._word_keys(_chunk(key)))]
        return out

    def _word_keys(self, text: str) -> list[str]:
        return [w[1:] if w[0] == " " and not w.isspace() else w + " " for w in self.pre_tokens(text)]

    @staticmethod
    def _segments(text: str) -> Iterator[str]:
        """The text in pieces cut before a space that starts a pre-token."""
        lo = 0
        while len(text) - lo > SEGMENT_CHARS:
            at = text.find(" ", lo + SEGMENT_CHARS)
            while 0 <= at < len(text) - 1 and text[at + 1].isspace():
                at = text.find(" ", at + 1)
            if at < 0 or at == len(text) - 1:
                break
            yield text[lo:at]
            lo = at
        yield text[lo:]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts and each text's offset in them (one more entry
        at the end)."""
        out, counts = [], np.zeros(len(texts) + 1, np.int64)
        keys: list[str] = []
        ends: list[tuple[int, int]] = []
        for i, t in enumerate(texts):
            for part in self._segments(t):
                keys += self._keys(part) if part else ()
                ends.append((i + 1, len(keys)))
                if len(keys) > SEGMENT_CHARS // 8:
                    out.append(self._ids_of(keys, ends, counts))
                    keys, ends = [], []
        out.append(self._ids_of(keys, ends, counts))
        return np.concatenate(out), np.cumsum(counts)

    def _ids_of(self, keys: list[str], ends: list[tuple[int, int]], counts: np.ndarray) -> np.ndarray:
        """Ids of the chunks; ``ends`` lists texts with the chunks up to their
        ends, and the ids of each are added to its count."""
        try:
            which = np.fromiter(map(self._at.__getitem__, keys), np.int64, len(keys))
        except KeyError:
            new = {k for k in keys if k not in self._at}
            if len(self._at) + 2 * len(new) > self._max or self._used > 8 * self._max:
                self._thin_out(2 * len(new))
                new = {k for k in keys if k not in self._at}
            self._learn(new)
            which = np.fromiter(map(self._at.__getitem__, keys), np.int64, len(keys))
        np.add.at(self._met, which, 1)
        ids, lens = self._gather(which)
        upto = np.concatenate([[0], np.cumsum(lens)])[[0, *[e for _, e in ends]]]
        np.add.at(counts, [i for i, _ in ends], np.diff(upto))
        return ids

    def decode(self, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids, and each text's offset in them."""
        size = self._size[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        data = self._flat[np.repeat(self._at_byte[ids] - ends[:-1], size) + np.arange(ends[-1])]
        return data, ends[off]


_CODECS: dict[str, Codec] = {}


def codec(path: str | None = None) -> Codec:
    """This Python worker's codec for the rank file."""
    key = path or ""
    if key not in _CODECS:
        _CODECS[key] = Codec(path)
    return _CODECS[key]


def _encoded(batches: Iterable[pa.RecordBatch], ranks: str | None) -> Iterator[pa.RecordBatch]:
    for b in batches:
        col = text_column(b)
        for lo, hi in runs(col, RUN_BYTES // 2):
            ids, off = codec(ranks).encode(col.slice(lo, hi - lo).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").slice(lo, hi - lo),
                 pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids.view(np.int32)))],
                ["doc_id", "ids"])


def _lists(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets (from 0) of a list column; a null list is empty."""
    n = np.asarray(col.value_lengths().fill_null(0), np.int64)
    return np.asarray(col.flatten(), np.int64), np.concatenate([[0], np.cumsum(n)])


def _decoded(batches: Iterable[pa.RecordBatch], ranks: str | None) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = b.column("ids")
        size = np.asarray(lists.value_lengths().fill_null(0), np.int64)
        step, done = np.cumsum(size), 0
        while done < len(lists):
            before = step[done - 1] if done else 0
            hi = max(int(np.searchsorted(step, before + RUN_BYTES // 4, "right")), done + 1)
            part = lists.slice(done, hi - done)
            data, at = codec(ranks).decode(*_lists(part))
            out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), hi - done, [
                None, pa.py_buffer(np.ascontiguousarray(at, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").slice(done, hi - done), part, out.cast(pa.binary())],
                ["doc_id", "ids", "bytes"])
            done = hi


def encode_documents(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """``doc_id`` and ``ids`` (list of int) of every whole text."""
    return docs.select("doc_id", "text").mapInArrow(
        lambda batches: _encoded(batches, ranks), f"doc_id {_id_type(docs)}, ids array<int>")


def decode_documents(tokens: DataFrame, ranks: str | None = None) -> DataFrame:
    """``doc_id``, ``ids`` and the ``bytes`` they stand for (UTF-8 of the text
    for the ids of a whole text; an id outside the vocabulary is an error)."""
    return tokens.select("doc_id", "ids").mapInArrow(
        lambda batches: _decoded(batches, ranks), f"doc_id {_id_type(tokens)}, ids array<int>, bytes binary")


def _id_type(df: DataFrame) -> str:
    return df.schema["doc_id"].dataType.simpleString()


def round_trip(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256`` (ids as little-endian unsigned
    32-bit integers) and ``decoded_sha256`` of every text: encoded, decoded
    and digested run by run in one pass, without an exchange."""
    def digest(batches):
        for b in _decoded(_encoded(batches, ranks), ranks):
            ids, off = _lists(b.column("ids"))
            raw = ids.astype("<u4")
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(np.diff(off)),
                 pa.array([hashlib.sha256(raw[lo:hi]).hexdigest() for lo, hi in zip(off[:-1].tolist(), off[1:].tolist())],
                          pa.string()),
                 pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in b.column("bytes")], pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(
        digest, f"doc_id {_id_type(docs)}, n_tokens long, ids_sha256 string, decoded_sha256 string")
