"""Hard negatives against plain Python integers."""

import math
import random

import numpy as np
import pytest

from tallyframe.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, row string, g int"


def brute(rows, every=100, n_pos=5, n_neg=10):
    kept = []
    for vec_id, emb, label in rows:
        if label is None or emb is None or any(x is None or not math.isfinite(x) for x in emb):
            continue
        if vec_id is not None and vec_id % 7 == 0:
            label = (label + 1) % 10
        kept.append((vec_id, label, [math.floor(256 * float(np.float32(x))) for x in emb]))
    out = []
    for i, (a_id, a_label, a) in enumerate(kept):
        if a_id is None or a_id % every:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(a, c)), v is None, v or 0, v, label, j)
                         for j, (v, label, c) in enumerate(kept)), key=lambda t: t[:3])
        for p in [t for t in scored if t[4] == a_label and t[5] != i][:n_pos]:
            fit = [t for t in scored if t[4] != a_label and 30 * -p[0] <= 100 * -t[0] <= 90 * -p[0]][:n_neg]
            out += [(a_id, p[3], r, t[3], -p[0], -t[0]) for r, t in enumerate(fit, 1)]
    return sorted(out, key=repr)


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    return sorted(map(tuple, hn.mine(df).collect()), key=repr)


def vectors(n, seed, dims=6, labels=4):
    r = random.Random(seed)
    return [(i, [r.gauss(0.1, 0.3) for _ in range(dims)], r.randrange(labels)) for i in range(n)]


@pytest.mark.parametrize("tile", [(1 << 10, 1 << 12), (16, 2)])
def test_equals_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(hn, "TILE_ROWS", (tile[0], tile[0]))
    monkeypatch.setattr(hn, "TILE_ANCHORS", tile[1])
    monkeypatch.setattr(hn, "SLICE_SCORES", 64)
    rows = vectors(420, 1)
    got = run(spark, rows)
    assert got == brute(rows) and len(got) > 100


def test_odd_rows_ties_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(hn, "TILE_ROWS", (20, 20))
    rows = vectors(60, 2, labels=2)
    rows += [(100, [0.5] * 6, 0), (100, [0.5] * 6, 0), (200, [], 1), (300, None, 1), (400, [0.1] * 6, None),
             (None, [0.4] * 6, 0), (None, [0.4] * 6, 1), (500, [float("nan")] * 6, 0), (600, [float("inf"), 1.0], 1),
             (700, [0.2, None], 1), (800, [0.3, 0.2], 1), (801, [-0.0] * 6, 0), (901, [-3.5] * 9, 0)]
    rows += [(1000 + i, [0.25] * 6, i % 3) for i in range(80)]  # a third of all rows, the same vector
    rows += [(7, [0.25] * 6, 0)] * 3
    assert run(spark, rows) == brute(rows)


def test_empty_tables(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, [0.5], 1)]) == []
    assert run(spark, [(100, [0.5], 1)]) == []


def test_exact_beyond_float32(spark):
    r = np.random.default_rng(0)
    for top, dims in ((200, 64), (90_000, 300), (1_000_000, 700)):
        a, b = r.integers(-top, top, (5, dims)), r.integers(-top, top, (9, dims))
        primes = hn.primes_for(dims * (top + 1) ** 2)
        assert np.array_equal(hn.exact_scores(a, b, primes), a @ b.T)
    assert all((p // 2) ** 2 * hn.CHUNK_DIMS < 1 << 24 for p in primes)
    with pytest.raises(ValueError):
        hn.primes_for(1 << 52)
    big = [(i, [300.0 * i, -7.25, float(i)], i % 3) for i in range(0, 400, 5)]
    assert run(spark, big) == brute(big)


def test_query_equals_sql(spark):
    import duckdb

    import __spark_entry__ as E
    from tests.conftest import SF_CHECK
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF_CHECK}/embeddings.parquet'")
    df = E.queries()["op13_hard_negatives"](spark, SF_CHECK)
    rel = con.execute(E.oracle_sql()["op13_hard_negatives"])
    names = [d[0] for d in rel.description]
    got, want = sorted(map(tuple, df.select(*names).collect())), sorted(rel.fetchall())
    assert got == want and len(got) > 0
