"""Spelling variants against edit distances by definition."""

import random
import re
import zlib
from collections import Counter

import pytest

from tallyframe.llm import word_variants as wv
from tests.llm.brute import ascii_lower


def near(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows, min_count=3):
    count = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = ascii_lower(run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    n = {w: k for w, k in count.items() if len(w) >= 5 and k >= min_count}
    out = {}
    for w, k in n.items():
        like = sorted((-n[v], v) for v in n if near(w, v))
        form = like[0][1] if like and -like[0][0] >= 2 * k else None
        out[w] = (form, k, len(like), n[form] if form else None)
    def root(w):
        return w if out[w][0] is None else root(out[w][0])
    return sorted((w, f, root(w), k, m, fn) for w, (f, k, m, fn) in out.items())


def random_words(n, seed, alphabet="abé", lo=1, hi=7):
    r = random.Random(seed)
    return sorted({"".join(r.choice(alphabet) for _ in range(r.randint(lo, hi))) for _ in range(n)})


@pytest.mark.parametrize("seed", range(6))
def test_acceptor_pairs(seed):
    words = random_words(120, seed, "abc"[:2 + seed % 2])
    want = sorted(tuple(sorted(p)) for i, a in enumerate(words) for p in [(a, b) for b in words[i + 1:]] if near(*p))
    got = [tuple(sorted(p)) for p in wv.Acceptor(words).near_pairs()]
    assert sorted(got) == want and len(set(got)) == len(got)


def test_acceptor_is_minimal_and_takes_long_words():
    a = wv.Acceptor(["abend", "abends", "rabend", "rabends"])
    assert len(a.final) == 3  # start, after "abend", end
    x = "q" * 50_000
    assert sorted(wv.Acceptor([x + "a", x + "ab", x + "b"]).near_pairs()) == sorted(
        [(x + "ab", x + "a"), (x + "a", x + "b"), (x + "ab", x + "b")])
    assert list(wv.Acceptor([]).near_pairs()) == [] == list(wv.Acceptor([""]).near_pairs())
    assert list(wv.Acceptor(["", "a"]).near_pairs()) == [("a", "")]


@pytest.mark.parametrize("limit", [1, 7, 10_000])
def test_split_groups(spark, limit):
    words = random_words(400, 9, "abc", 1, 6) + ["zzzz" + w for w in random_words(60, 3, "abz", 1, 5)]
    words = sorted(set(words))
    n = {w: 1 + len(w) * 7 % 5 for w in words}
    got = {r.word: (r.n_near, r.near, r.near_n) for r in wv.near_words(
        spark.createDataFrame(list(n.items()), "word string, n long"), limit).collect()}
    want = {}
    for w in words:
        like = sorted((-n[v], v) for v in words if near(w, v))
        if like:
            want[w] = (len(like), like[0][1], -like[0][0])
    assert got == want


def corpus(seed, n_docs=60):
    r = random.Random(seed)
    stems = ["colour", "flavour", "analyse", "cenêtre", "proßeß", "naïveté", "wonderful"]
    rows = []
    for d in range(n_docs):
        words = []
        for _ in range(80):
            w = r.choice(stems)
            if r.random() < 0.3:
                i = r.randrange(len(w))
                w = w[:i] + r.choice(["", "x", "÷", w[i] * 2]) + w[i + 1:]
            words.append(r.choice([w, w.upper(), w.title()]))
        rows.append((d, " ".join(words)))
    return rows


def test_variants_equal_brute_force(spark, make_docs, monkeypatch):
    monkeypatch.setattr(wv, "HELD_WORDS", 20)
    rows = corpus(5) + [(None, "colour " * 4), (None, "colour"), (7, None), (8, ""), (9, "\n 123"), (3, corpus(5)[3][1])]
    docs = make_docs(rows).withColumnRenamed("lang", "word").withColumnRenamed("source", "n")
    got = sorted(map(tuple, wv.variants(docs).collect()))
    assert got == brute(rows)
    assert any(r[1] for r in got) and any(r[2] != r[0] and r[1] != r[2] for r in got)  # chains of two steps


def test_very_long_run_and_empty_table(spark, make_docs):
    x = "ab" * 300_000
    rows = [(1, x), (2, x), (3, x + "c"), (4, x + "c"), (5, x + "c"), (6, x)]
    got = {len(r.word): (r.n, r.n_near) for r in wv.variants(make_docs(rows), delete_every=None).collect()}
    assert got == {600_000: (3, 1), 600_001: (3, 1)}
    assert wv.variants(make_docs([])).count() == 0
    assert wv.variants(make_docs([(1, "only one")])).count() == 0


def test_query_equals_sql(spark):
    import duckdb

    import __spark_entry__ as E
    from tests.conftest import SF_SMALL
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_SMALL}/documents.parquet'")
    df = E.queries()["op12_word_variants"](spark, SF_SMALL)
    rel = con.execute(E.oracle_sql()["op12_word_variants"])
    names = [d[0] for d in rel.description]
    key = lambda r: tuple(map(str, r))
    got, want = sorted(map(tuple, df.select(*names).collect()), key=key), sorted(rel.fetchall(), key=key)
    assert got == want and len(got) > 100
