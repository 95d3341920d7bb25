"""Exact encoding, token files and packing."""

import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings, strategies as st

from tallyframe.llm import packing, token_files
from tallyframe.llm._tokens import Encoder, encoder
from tests.conftest import SF_SMALL
from tests.llm.conftest import text_of

ODD = ["", " ", "a", "Hello, World!! <|startoftext|> x", "<|ENDOFTEXT|>", "İstanbul ΑΣ ΣΑΣ.", "Éa, x y z\x1c.q",
       "don't, it's. 'll WE'RE", "ﬁ①², a٣.", "naïve,\r\n\tb", "क़ख़ ज़", "e\u0301 E\u0301", "x,, y.; ..", "a\x00b \x85 \xa0c",
       "<|endoftext|>abc", "x" * 5000, "ABC123def", "🙂🙂 a🙂"]


def library_ids(texts):
    return [e.ids + [1] for e in encoder()._tok.encode_batch(texts, add_special_tokens=False)]


def split(ids, off):
    return [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:])]


def test_ids_equal_the_librarys(spark):
    texts = ODD + [r.text or "" for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    assert split(*encoder().encode(texts)) == library_ids(texts)


def test_a_full_cache_starts_anew():
    e = Encoder(cache_chunks=50)
    texts = [text_of(i, 40) for i in range(6)]
    for _ in range(2):
        for t in texts:
            assert split(*e.encode([t])) == library_ids([t])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=4))
def test_any_text(texts):
    assert split(*encoder().encode(texts)) == library_ids(texts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("aZé ÀÿßñÓ×÷µª9',.<|>\n\t\u0301\xa0", max_size=40), min_size=1, max_size=5))
def test_latin_letters_and_marks(texts):
    assert split(*Encoder(cache_chunks=200).encode(texts)) == library_ids(texts)


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def test_token_files_round_trip(spark, make_docs, tmp_path):
    rows = [(i * 7 % 50, text_of(i, 5 + i * 3)) for i in range(50)] + [(60, None), (61, ""), (None, "first"), (60, "z")]
    token_files.write_token_files(make_docs(rows), str(tmp_path / "t"), keep=("source",), row_group_bytes=1 << 16)
    got = token_files.read_tokens(spark, str(tmp_path / "t")).collect()
    got.sort(key=lambda r: r.start)
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    assert [r.doc_id for r in got] == [r[0] for r in want]
    assert [list(r.ids) for r in got] == library_ids([r[1] or "" for r in want])
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    assert {r.source for r in got} == {"s"}
    meta = token_files.read_metadata(spark, str(tmp_path / "t"))
    read = re.findall(r"ReadSchema: (.*)", meta._jdf.queryExecution().executedPlan().toString())
    assert "ids" not in meta.columns and read and not any("ids:" in x for x in read)
    assert [r.doc_id for r in token_files.read_tokens(spark, str(tmp_path / "t"), [8]).collect()] == [8]


def test_file_format(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    token_files.write_token_files(docs.repartition(2), str(tmp_path / "t"), page_rows=10)
    path = next(p for p in sorted((tmp_path / "t").glob("*.parquet")) if pq.ParquetFile(p).metadata.num_rows)
    group = pq.ParquetFile(path).metadata.row_group(0)
    found = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
    assert "RLE_DICTIONARY" in found["ids.list.element"].encodings
    for name in ("doc_id", "n_tokens", "local_start"):
        assert found[name].encodings == ("DELTA_BINARY_PACKED",)
    assert all(c.has_column_index and c.has_offset_index for c in found.values())


def test_token_files_refuse_clashes_and_take_empty_tables(spark, make_docs, tmp_path):
    with pytest.raises(ValueError):
        token_files.write_token_files(make_docs([]).withColumnRenamed("lang", "ids"), str(tmp_path / "x"), keep=("ids",))
    token_files.write_token_files(make_docs([]), str(tmp_path / "e"))
    assert token_files.token_digests(token_files.read_tokens(spark, str(tmp_path / "e"))).count() == 0


def test_token_query(spark):
    import __spark_entry__ as E
    rows = sorted(spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect(), key=lambda r: r.doc_id)
    ids = library_ids([r.text or "" for r in rows])
    start = np.cumsum([0] + [len(x) for x in ids])[:-1].tolist()
    want = [(r.doc_id, s, len(x), crc(x)) for r, s, x in zip(rows, start, ids)]
    got = E.queries()["op10_token_files"](spark, SF_SMALL).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == want


# --- packing ---------------------------------------------------------------------

def check_plan(lengths, tiers=packing.TIERS):
    p = packing.plan_group(np.asarray(lengths, np.int64), tiers)
    cover = [[] for _ in lengths]
    for d, s, n in zip(p["doc"], p["start"], p["length"]):
        assert n > 0
        cover[d].append((s, s + n))
    for n, c in zip(lengths, cover):
        c.sort()
        assert [a for a, _ in c] == [0, *[b for _, b in c[:-1]]] and c[-1][1] == n
    total = np.bincount(p["seq"], weights=p["length"]).astype(int)
    for s in range(len(total)):
        at = np.flatnonzero(p["seq"] == s)
        at = at[np.argsort(p["offset"][at])]
        assert p["offset"][at].tolist() == [0, *np.cumsum(p["length"][at])[:-1].tolist()]
        assert len(set(p["tier"][at])) == 1 and total[s] <= p["tier"][at[0]]
    short = [t for s, t in enumerate(total) if t not in tiers]
    assert len(short) <= 1 and all(t < max(tiers) for t in short)
    return p, total


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(1, 5000), min_size=1, max_size=60))
def test_plan_covers_and_fills(lengths):
    check_plan(lengths)


def test_plan_prefers_whole_documents():
    p, total = check_plan([1500, 548, 900, 124, 200, 56])
    assert len(p["doc"]) == 6 and sorted(total.tolist()) == [256, 1024, 2048]


def test_steps_are_balanced():
    r = np.random.default_rng(1)
    p = packing.plan_group(r.integers(1, 3000, 4000))
    first = np.unique(p["seq"], return_index=True)[1]
    tier, step = p["tier"][first], p["step"][first]
    for size in np.unique(tier):
        count = np.unique(step[tier == size], return_counts=True)[1]
        assert count.max() - count.min() <= 1
    cost = np.bincount(p["step"], weights=p["length"].astype(float) ** 2)[np.unique(step[tier == 2048])]
    assert cost.max() < 1.05 * cost.min()


def test_packing_query(spark):
    import __spark_entry__ as E
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    ids = dict(zip(texts, library_ids(list(texts.values()))))
    got = E.queries()["op8_packing"](spark, SF_SMALL).collect()
    seen, total = {}, {}
    for r in got:
        assert r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == crc(ids[r.doc_id][r.start:r.start + r.length])
        seen.setdefault(r.doc_id, []).append((r.start, r.start + r.length))
        total.setdefault(r.sequence_id, []).append((r.offset, r.offset + r.length))
    assert seen.keys() == ids.keys()
    for d, c in seen.items():
        c.sort()
        assert [a for a, _ in c] == [0, *[b for _, b in c[:-1]]] and c[-1][1] == len(ids[d])
    for c in total.values():
        c.sort()
        assert [a for a, _ in c] == [0, *[b for _, b in c[:-1]]] and c[-1][1] <= 2048


def test_packing_odd_rows(make_docs):
    rows = [(1, None), (2, ""), (None, "a b"), (4, text_of(3, 4000)), (4, text_of(3, 4000))]
    got = packing.pack(make_docs(rows), with_ids=True, group_tokens=3000).collect()
    assert sum(r.length for r in got) == sum(map(len, library_ids([t or "" for _, t in rows])))
    assert all(len(r.ids) == r.length and crc(r.ids) == r.ids_crc32 for r in got)
    assert {r.doc_id for r in got} == {1, 2, 4, None}
    assert packing.pack(make_docs([])).count() == 0


@pytest.mark.parametrize("parts", [1, 40])
def test_padding_does_not_follow_the_split(make_docs, parts):
    rows = [(i, text_of(i, 20 + i % 90)) for i in range(200)] + [(None, text_of(7, 3000))]
    got = packing.pack(make_docs(rows).repartition(parts), with_ids=True).collect()
    total, cover = {}, {}
    for r in got:
        assert len(r.ids) == r.length and crc(r.ids) == r.ids_crc32
        total.setdefault(r.sequence_id, []).append((r.offset, r.length, r.tier))
        cover.setdefault(r.doc_id, []).append((r.start, list(r.ids)))
    for (d, _), ids in zip(rows, library_ids([t for _, t in rows])):
        pieces = sorted(cover[d])
        assert [x for _, p in pieces for x in p] == ids
        assert [a for a, _ in pieces] == [0, *np.cumsum([len(p) for _, p in pieces])[:-1].tolist()]
    short = 0
    for c in total.values():
        c.sort()
        assert [a for a, _, _ in c] == [0, *np.cumsum([n for _, n, _ in c])[:-1].tolist()]
        short += sum(n for _, n, _ in c) < c[0][2]
    assert short <= 1


def test_short_windows_of_many_tasks_are_packed_in_bounded_groups(make_docs):
    rows = [(i, text_of(i, 60)) for i in range(64)]
    got = packing.pack(make_docs(rows).repartition(32), group_tokens=4 * 2048).collect()
    total = {}
    for r in got:
        total[r.sequence_id, r.tier] = total.get((r.sequence_id, r.tier), 0) + r.length
    assert sum(r.length for r in got) == sum(map(len, library_ids([t for _, t in rows])))
    assert sum(n < tier for (_, tier), n in total.items()) <= 32 // 4
