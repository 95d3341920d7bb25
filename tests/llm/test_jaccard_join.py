import numpy as np
import pytest

from tallyframe.llm import jaccard_join as jj
from tallyframe.llm.components import components
from tests.conftest import SF_SMALL
from tests.llm import brute
from tests.llm.conftest import text_of


def result(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=repr)


def chain(n, base=400, step=14, seed=5):
    """Texts that drift: near neighbours link, far ones do not."""
    w = text_of(seed, base + n * step, 10 ** 6).split()
    return [" ".join(w[i * step:i * step + base]) for i in range(n)]


@pytest.mark.parametrize("min_count", [2, 24])
def test_against_brute_force(make_docs, monkeypatch, min_count):
    """Frequent tokens change the index, never the result."""
    monkeypatch.setattr(jj, "MIN_COUNT", min_count)
    boiler = text_of(77, 60, 10 ** 6)
    rows = [(1000 + i, t) for i, t in enumerate(chain(12))]
    rows += [(i, text_of(i, 100) + "\n" + boiler) for i in range(30)]            # shared passage, own text
    rows += [(100 + i, boiler + f" tail{i} end{i}") for i in range(30)]           # mostly the passage
    rows += [(200 + i, text_of(9, 50)) for i in range(30)]                        # copies
    rows += [(300 + i, text_of(9, 50).replace("w", "W") + f"\nextra{i}") for i in range(5)]
    rows += [(400, None), (401, ""), (402, " \t\n"), (403, "one two"), (404, "One  two"), (405, "one two three"),
             (None, "one two"), (None, "no id here but some six words")]
    rows += [(500 + i, " ".join(f"t{j}" for j in range(i, i + 14))) for i in range(8)]  # small sets
    assert result(jj.linked_documents(make_docs(rows))) == sorted(brute.jaccard(rows), key=repr)


def test_threshold_is_inclusive(make_docs):
    w = [f"v{i}" for i in range(40)]
    rows = [(1, " ".join(w[:11])), (2, " ".join(w[1:10]))]  # 7 and 5 shingles, 5 shared: 5/7
    rows += [(3, " ".join(w[20:32])), (4, " ".join(w[20:30]))]  # 8 and 6 shingles, 6 shared: 3/4
    got = dict((d, c) for d, _, c in result(jj.linked_documents(make_docs(rows))))
    assert got == {1: 1, 2: 2, 3: 3, 4: 3}


@pytest.mark.parametrize("seed", range(4))
def test_signatures_meet_for_every_linked_pair(seed):
    """Whatever tokens count as frequent, linked sets share a signature."""
    r = np.random.default_rng(seed)
    for n in (3, 8, 20, 21, 22, 30, 80, 300):
        for _ in range(40):
            x = np.unique(r.integers(0, 2 ** 63, n, dtype=np.uint64))
            other = r.integers(0, 2 ** 63, n, dtype=np.uint64)
            keep = x[r.random(len(x)) < 0.92]
            y = np.unique(np.concatenate([keep, other[:int(r.integers(0, max(1, n // 6) + 1))]]))
            both = len(np.intersect1d(x, y))
            if not len(y) or 100 * both < 75 * (len(x) + len(y) - both):
                continue
            every = np.union1d(x, y)
            frequent = np.sort(every[r.random(len(every)) < r.choice([0, 0.3, 0.9, 1.0])])
            a, b = (jj.prefix_signatures(s, frequent) for s in (x, y))
            assert len(np.intersect1d(a, b)), (n, len(x), len(y), both, len(frequent))


@pytest.mark.parametrize("first", [16, 0])
def test_pairs_across_components_are_given_once(make_docs, monkeypatch, first):
    """Texts just below the threshold share very many lists, yet each pair is
    given by one; what is kept of a node's signatures never loses a pair."""
    import random
    monkeypatch.setattr(jj, "FIRST", first, raising=False)
    base, rows = text_of(3, 800, 10 ** 6).split(), []
    for i in range(14):
        w, r = list(base), random.Random(i)
        for j in r.sample(range(0, 800, 5), 13):
            w[j] = f"own{i}x{j}"
        rows += [(10 * i, " ".join(w)), (10 * i + 1, " ".join(w) + " one more")]
    given, admissible = [], jj._admissible

    def counted(pairs):
        given.append((pairs.count(), pairs.distinct().count()))
        return admissible(pairs)
    monkeypatch.setattr(jj, "_admissible", counted)
    assert result(jj.linked_documents(make_docs(rows))) == sorted(brute.jaccard(rows), key=repr)
    made, distinct = given[1]
    assert distinct > 50 and (made == distinct if first else made > distinct)


def test_lists_survive_batch_borders():
    """The same rows in batches of any size give the same index rows."""
    import pyarrow as pa
    r = np.random.default_rng(0)
    rows = sorted({(int(s), int(n), int(k)) for s, k, n in zip(r.integers(0, 40, 300), r.integers(0, 25, 300),
                                                                 np.zeros(300))})
    rows = sorted(rows + rows[::7])
    sig, n, key = (np.array(x) for x in zip(*rows))

    def run(size):
        batches = (pa.RecordBatch.from_arrays([pa.array(c[i:i + size]) for c in (sig, key, n)], ["sig", "key", "n"])
                   for i in range(0, len(sig), size))
        return [tuple(x.values()) for b in jj._shared(batches) for x in b.to_pylist()]
    want = run(10 ** 6)
    assert want and all(run(size) == want for size in (1, 2, 3, 7, 50))


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, 105), (105, 103), (7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 100, 103: 100, 105: 100, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def kept(make_docs, rows):
    return sorted(((r.doc_id, r.text) for r in jj.keep_one(make_docs(rows)).collect()), key=repr)


def test_keep_one_and_empty(make_docs):
    one, two = text_of(1, 40), text_of(2, 40)
    rows = [(5, one), (3, one), (3, one), (9, two), (8, None), (None, "a")]
    docs = make_docs(rows).withColumnRenamed("lang", "no").withColumnRenamed("source", "row")
    assert jj.keep_one(docs).columns == ["doc_id", "text", "no", "row", "n_chars"]
    assert kept(make_docs, rows) == sorted([(3, one), (9, two), (8, None), (None, "a")], key=repr)
    assert jj.linked_documents(make_docs([])).count() == 0 and jj.keep_one(make_docs([])).count() == 0


def test_keep_one_with_repeated_and_null_ids(make_docs):
    a, b = text_of(1, 40), text_of(2, 40)
    near = a.replace("x.", "x.", 1) + " tail"  # linked with a, another text
    assert kept(make_docs, [(1, a), (None, a), (None, b)]) == [(1, a), (None, b)]
    assert kept(make_docs, [(3, a), (5, a), (5, b)]) == [(3, a), (5, b)]
    assert kept(make_docs, [(5, b), (5, a), (5, a), (7, near)]) == sorted([(5, a), (5, b)], key=repr)
    assert len(kept(make_docs, [(None, a), (None, near), (None, b)])) == 2
    blank = [(4, ""), (4, ""), (4, None), (6, " "), (None, ""), (None, "")]
    assert kept(make_docs, blank) == sorted([(4, ""), (4, None), (6, " "), (None, "")], key=repr)


def test_query_against_brute_force(spark):
    import __spark_entry__ as E
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    assert result(E.queries()["op4_jaccard_join"](spark, SF_SMALL)) == sorted(brute.jaccard(rows), key=repr)
