import hashlib

import pytest

from tallyframe.llm import line_dedup as ld
from tests.conftest import SF_SMALL
from tests.llm import brute

LONG = "A shared line of more than twenty"


def result(df):
    return sorted(((r.doc_id, r._ld_lines, r._ld_dropped, r.text or "") for r in df.collect()), key=repr)


@pytest.mark.parametrize("batches,fanout", [(1, 4), (5, 2)])
def test_against_brute_force(make_docs, batches, fanout):
    rows = [(i, "\n".join([LONG.upper() + " \t", f"own line number {i} is quite long", "short",
                           f"line of group {i % 4}, shared by some"] * (1 + i % 2))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, LONG), (103, "ü" * 19), (104, "ü" * 20), (105, "ü" * 20), (106, "Ü" * 20),
             (107, "ü" * 20 + "\r"), (None, LONG + "\nmore"), (None, "lonely line without a document id")]
    got = result(ld.drop_lines(make_docs(rows), batches=batches, fanout=fanout))
    assert got == sorted(brute.line_dedup(rows), key=repr)


def test_repeated_rows_and_extra_columns(make_docs):
    rows = [(1, LONG + "\nx"), (1, LONG + "\nx"), (2, LONG + "\ny")]
    out = ld.drop_lines(make_docs(rows))
    assert result(out) == sorted([(1, 2, 1, "x"), (1, 2, 1, "x"), (2, 2, 0, LONG + "\ny")])
    assert out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r.source for r in out.collect()} == {"s"}


def test_empty_table(make_docs):
    assert ld.drop_lines(make_docs([])).count() == 0


def test_runs_are_sorted_levelled_and_compacted(spark, make_docs, tmp_path):
    runs = ld.LineRuns(spark, str(tmp_path / "runs"), fanout=2)
    for i in range(5):
        runs.add(ld.key_rows(make_docs([(10 - i, f"{LONG}\nline {i} alone, long enough to count")])))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    for path in (p for level in runs.levels for p in level):
        rows = [(r.h1, r.h2) for r in spark.read.parquet(path).coalesce(1).collect()]
        assert len(rows) == len(set(rows))
    assert [r.last_doc for r in runs.repeated().collect()] == [10]
    # the key was settled after the fourth batch, so the fifth adds its own line alone
    assert spark.read.parquet(runs.levels[0][0]).count() == 1


def test_query_against_brute_force(spark):
    import __spark_entry__ as E
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    want = [(d, n, k, hashlib.sha256(t.encode()).hexdigest())
            for d, n, k, t in brute.line_dedup([(r.doc_id, r.text) for r in docs])]
    got = E.queries()["op2_line_dedup"](spark, SF_SMALL).collect()
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in got) == sorted(want)
