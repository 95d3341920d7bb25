"""Byte-level BPE against the library that reads rank files itself."""

import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from tallyframe.llm import byte_bpe
from tests.conftest import SF_SMALL
from tests.llm.conftest import text_of

ODD = ["", " ", "  ", "\n", "a", " a", "a ", "a  b", "a \n b", "a\n\nb", "a\n\n\nb", "a\n\n b", "x\n\n", "\n\nx", "x\n x",
       "don't we'RE I'll 's", "tab\there \t x", "nb\xa0sp \xa0 x　y", "\x1c \x1c\x1d", "a\x00b", "naïve Éa ﬁ①²३ 12a3",
       "漢字かな交じり文。 " * 20, "🙂🙂 a🙂", "a\U00016ea0b \U00010ee0 \U00012550 1\U000125501", "x" * 5000, "ab" * 3000 + " c",
       "é ​‍", "<|endoftext|> <unk> ▁ Ā ā", "A\r\nB\r\n\r\nC", "\u0085x \u0085", "  lead", "trail\n"]


@pytest.fixture(scope="module")
def library():
    with open(byte_bpe.default_ranks(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def check(codec, library, texts):
    ids, off = codec.encode(texts)
    got = [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:])]
    for t, g in zip(texts, got):
        assert g == library.encode_ordinary(t), repr(t[:80])
    data, at = codec.decode(ids.astype(np.int64), off)
    assert [data[a:b].tobytes().decode() for a, b in zip(at[:-1], at[1:])] == texts


def test_odd_texts(library):
    check(byte_bpe.codec(), library, ODD)


def test_every_piece_is_itself(library):
    c = byte_bpe.codec()
    pieces = byte_bpe.read_ranks(byte_bpe.default_ranks())
    assert c._sp.encode([byte_bpe.to_letters(p) for p in pieces], num_threads=1) == [[i] for i in range(len(pieces))]
    assert byte_bpe.from_letters(byte_bpe.to_letters(bytes(range(256)))) == bytes(range(256))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("ab'stE1 \n\t\r.,-é\xa0　漢🙂\x1c")), max_size=30), max_size=4))
def test_any_text(library, texts):
    check(byte_bpe.codec(), library, texts)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_code_points(library, text):
    check(byte_bpe.codec(), library, [text])


def test_small_cache_and_long_texts(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "SEGMENT_CHARS", 500)
    c = byte_bpe.Codec(cache_chunks=40)
    check(c, library, [text_of(1, 3000), "w  " * 400, ("a\n\n b c\n" * 300), text_of(2, 900), "x" * 3000])


def test_rank_file_with_gaps(tmp_path):
    p = tmp_path / "r"
    p.write_bytes(b"YQ== 0\nYg== 1\n")
    assert byte_bpe.read_ranks(str(p)) == [b"a", b"b"]
    p.write_bytes(b"YQ== 0\nYg== 0\n")
    with pytest.raises(ValueError):
        byte_bpe.read_ranks(str(p))


def test_query_equals_the_library(spark, library):
    import __spark_entry__ as E
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    want = {}
    for r in docs:
        ids = library.encode_ordinary(r.text or "")
        want[r.doc_id] = (len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(),
                          hashlib.sha256((r.text or "").encode()).hexdigest())
    got = E.queries()["op11_byte_bpe"](spark, SF_SMALL).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == want and len(got) == len(docs)


def test_documents_both_ways(spark, make_docs, library):
    rows = [(1, None), (2, ""), (None, "a b"), (4, text_of(3, 400)), (4, text_of(3, 400)), (None, "a b")]
    docs = make_docs(rows).withColumnRenamed("lang", "ids").withColumnRenamed("source", "bytes")
    tokens = byte_bpe.encode_documents(docs)
    assert tokens.columns == ["doc_id", "ids"]
    key = lambda x: (x[0] is None, x)
    assert (sorted(((r.doc_id, r.ids) for r in tokens.collect()), key=key)
            == sorted(((d, library.encode_ordinary(t or "")) for d, t in rows), key=key))
    back = byte_bpe.decode_documents(tokens).collect()
    assert sorted((r.doc_id or 0, bytes(r.bytes).decode()) for r in back) == sorted((d or 0, t or "") for d, t in rows)
    assert byte_bpe.round_trip(make_docs([])).count() == 0
    assert byte_bpe.decode_documents(byte_bpe.encode_documents(make_docs([]))).count() == 0
