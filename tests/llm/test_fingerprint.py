import hashlib

import numpy as np
import pyarrow as pa

from tallyframe.llm import fingerprint as fp
from tests.conftest import SF_SMALL
from tests.llm import brute
from tests.llm.conftest import text_of


def vec(*texts):
    return fp.vectors(pa.array(list(texts), pa.large_string()))


def test_equal_multisets_of_paragraphs_in_any_order():
    a, b, c = vec("one line\nand two\nand two", "and two\none line\nand two", "one line\nand two")
    assert (a == b).all() and (a[:256] != c[:256]).any()


def test_insert_and_delete_paragraphs():
    whole, part, rest = vec("alpha beta\ngamma delta epsilon zeta eta\ntheta", "alpha beta\ntheta",
                            "gamma delta epsilon zeta eta")
    assert fp.combine(part.tobytes(), rest.tobytes()) == whole.tobytes()
    assert fp.combine(whole.tobytes(), rest.tobytes(), -1) == part.tobytes()


def test_likeness_follows_shared_shingles():
    t = text_of(1, 2000)
    half = fp.edited(t, text_of(2, 2000))
    v = vec(t, half, text_of(3, 2000), t)
    near = fp.likeness(np.repeat(v[:1], 4, 0), v)
    assert near[0] == near[3] == 1 and 0.35 < near[1] < 0.65 and near[2] < 0.25


def test_query_against_brute_force(spark):
    import __spark_entry__ as E
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = brute.edited_rows(list(texts.items()))
    got = E.queries()["op1_fingerprint"](spark, SF_SMALL).collect()
    assert len(got) == len(texts)
    prints = {r.doc_id: r.fingerprint for r in got}
    for r in got:
        n, changed, following = want[r.doc_id]
        assert r.n_chars == n
        assert r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert r.edited_fingerprint == fp.as_text(vec(changed))[0]
        assert r.fingerprint == fp.as_text(vec(texts[r.doc_id] or ""))[0]
        assert (prints[following] == r.fingerprint) <= (r.near_next == 1)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1


def test_odd_rows(make_docs):
    rows = [(1, "a"), (2, None), (3, ""), (4, "x y\nz"), (4, "x y\nz"), (None, "lost"), (7, "é\n" * 5000)]
    got = fp.edited_pairs(make_docs(rows), ranges=3).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert [r.n_chars for r in by[2]] == [0] and len(by[4]) == 2
    # 2 is followed by 1, 1 by the row without an id, and that by 7
    assert by[1][0].edited_sha256 == hashlib.sha256(b"a").hexdigest()
    assert by[None][0].edited_sha256 == hashlib.sha256("loé\n".encode()).hexdigest()
    assert by[7][0].edited_sha256 == hashlib.sha256((("é\n" * 2500) + "x y\nz").encode()).hexdigest()
    one = fp.edited_pairs(make_docs([(5, "abcd")]), ranges=4).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    assert fp.edited_pairs(make_docs([]), ranges=4).count() == 0


def test_ranges_do_not_change_the_result(make_docs):
    docs = make_docs([(i * 3, text_of(i, 30 + i)) for i in range(60)])
    a, b = (sorted(map(tuple, fp.edited_pairs(docs, ranges=n).collect())) for n in (1, 9))
    assert a == b
