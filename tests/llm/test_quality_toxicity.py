import math
import random

import numpy as np
import pyarrow as pa

from tallyframe.llm import quality_crf as qc, toxicity_fm as fm
from tests.conftest import SF_CHECK, SF_SMALL
from tests.llm import brute
from tests.llm.conftest import text_of

BAD = "\n".join(" ".join(f"junk{i}{j}***" for j in range(12)) for i in range(8))


def labels_of(spark, rows, name):
    return spark.createDataFrame(rows, f"doc_id long, {name} int")


def test_base_measures_against_brute_force(spark):
    import __spark_entry__ as E
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    for r in E.queries()["op5_quality_crf"](spark, SF_SMALL).collect():
        want = brute.base_measures(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept) and 0 <= r.content_words <= r.n_words


def test_odd_texts(spark, make_docs):
    rows = [(1, None), (2, ""), (3, " \n\t\n"), (4, "a b a b a b"), (5, "same line\nsame line\n \nsame line"),
            (None, "é ü\r\nx"), (7, "w " * 30000), (8, text_of(4, 90)), (8, text_of(4, 90)), (9, "x\n\n\ny\n")]
    got = qc.quality_measures(make_docs(rows), qc.Field()).collect()
    assert [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got] == [
        brute.base_measures(t) for _, t in rows]
    assert [r.kept for r in got] == [False] * 7 + [True] * 2 + [False]
    assert qc.quality_measures(make_docs([]), qc.Field()).count() == 0


def test_training_without_labels_leaves_the_base_rules(spark, make_docs):
    docs = make_docs([(1, text_of(1, 80)), (2, BAD)])
    for rows in ([], [(1, None)], [(1, 1)]):
        field = qc.train_field(docs, labels_of(spark, rows, "quality"))
        assert not field.weight.any()
        assert [r.kept for r in qc.quality_measures(docs, field).collect()] == [True, True]


def test_filter_keeps_columns_and_good_documents(spark, make_docs):
    rows = [(i, text_of(i, 120)) for i in range(30)] + [(100 + i, BAD.replace("junk", f"j{i}")) for i in range(10)]
    docs = make_docs(rows).withColumnRenamed("lang", "kept")
    field = qc.train_field(docs, labels_of(spark, [(d, int(d < 100)) for d, _ in rows], "quality"))
    out = qc.filter_quality(docs, field)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == list(range(30))


def random_chains(seed, n=6):
    r = np.random.default_rng(seed)
    sizes = r.integers(0, 5, n)
    feature = np.stack([r.integers(b, b + s, sizes.sum()) for b, s in zip(qc._BASE, qc._SIZES)], 1).astype(np.uint8)
    field = qc.Field(r.normal(size=(qc.N_FEATURES, 2)), r.normal(size=(2, 2)))
    return field, feature, np.concatenate([[0], np.cumsum(sizes)])


def paths(field, feature):
    from itertools import product
    score = field.weight[feature].sum(1)
    for p in product((0, 1), repeat=len(feature)):
        yield p, sum(score[i, y] for i, y in enumerate(p)) + sum(field.move[a, b] for a, b in zip(p, p[1:]))


def test_viterbi_and_likelihood_against_all_paths():
    for seed in range(8):
        field, feature, first = random_chains(seed)
        label = field.viterbi(feature, first)
        gold = np.random.default_rng(seed).integers(0, 2, len(feature))
        like = 0.0
        for a, b in zip(first[:-1], first[1:]):
            if a == b:
                continue
            every = dict(paths(field, feature[a:b]))
            assert every[tuple(label[a:b])] == max(every.values())
            like += every[tuple(gold[a:b])] - np.logaddexp.reduce(list(every.values()))
        got, g_weight, g_move = field._likelihood(feature, first, gold)
        assert abs(got - like) < 1e-8
        for arr, grad, at in ((field.weight, g_weight, (3, 1)), (field.move, g_move, (0, 1))):
            arr[at] += 1e-5
            up = field._likelihood(feature, first, gold)[0]
            arr[at] -= 2e-5
            down = field._likelihood(feature, first, gold)[0]
            arr[at] += 1e-5
            assert abs((up - down) / 2e-5 - grad[at]) < 1e-4


def test_quality_on_held_out_labels(spark):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    labels = spark.read.parquet(f"{SF_CHECK}/labels.parquet")
    field = qc.train_field(docs, labels.where("doc_id % 2 = 0"))
    got = {r.doc_id: r for r in qc.quality_measures(docs, field).collect()}
    test = [(r.quality, got[r.doc_id]) for r in labels.where("doc_id % 2 = 1").collect()]
    good = [m.kept or m.base_failed for q, m in test if q == 1]
    bad = [m.kept for q, m in test if q == 0]
    assert np.mean(good) >= 0.98 and np.mean(bad) <= 0.1


# --- toxicity ----------------------------------------------------------------------

def margin_of(machine, present):
    at = [i for i, h in enumerate(machine.known) if h in present]
    out = machine.bias + machine.weight[at].sum()
    for i, a in enumerate(at):
        for b in at[:i]:
            out += machine.factor[a] @ machine.factor[b]
    return out


def hashes(text):
    return fm.terms(pa.array([text], pa.large_string()), 0, 1)[0]


def test_margin_against_pairwise_sums():
    r = np.random.default_rng(3)
    known = np.sort(hashes(" ".join(f"t{i}" for i in range(20))))
    m = fm.Machine(known, r.normal(size=20), r.normal(size=(20, 4)), -0.3)
    texts = ["t1 T2, t3! t3", "", "zz", "t5-t6 t7.t8 " * 3]
    for t in texts:
        h, doc = fm.terms(pa.array([t], pa.large_string()), 0, 1)
        assert abs(m.margin(*m.active(h, doc), 1)[0] - margin_of(m, set(h))) < 1e-9


def test_learns_a_pair_that_single_terms_do_not_tell():
    """An insult alone and a group alone are harmless; both together are not."""
    r = random.Random(5)
    texts, y = [], []
    for _ in range(900):
        a, b = r.random() < 0.5, r.random() < 0.5
        w = [f"f{r.randrange(40)}" for _ in range(12)] + ["insult"] * a + ["group"] * b
        r.shuffle(w)
        texts.append(" ".join(w))
        y.append(float(a and b))
    h, doc = fm.terms(pa.array(texts, pa.large_string()), 0, len(texts))
    m = fm.fit(h, doc, np.array(y), epochs=40)
    s = {t: fm.sigmoid(m.margin(*m.active(hashes(t), np.zeros(len(hashes(t)), np.int64)), 1))[0]
         for t in ("f1 f2 insult", "f1 f2 group", "f1 f2", "f1 f2 insult group")}
    assert s["f1 f2 insult group"] > 0.8 and max(v for t, v in s.items() if t != "f1 f2 insult group") < 0.4
    i, g = (int(np.searchsorted(m.known, hashes(w)[0])) for w in ("insult", "group"))
    assert m.factor[i] @ m.factor[g] > 0.5


def test_learns_a_rare_term_that_tells_only_in_a_pair():
    """A group in 3% of rows, toxic about as often as all rows, but always beside a partner."""
    r = random.Random(11)
    texts, y = [], []
    for _ in range(5000):
        a, b = r.random() < 0.03, r.random() < 0.1
        c = r.random() < (0.03 if a else 0.1)
        w = [f"f{r.randrange(3000)}" for _ in range(15)] + ["vile"] * c + ["group"] * a + ["partner"] * b
        texts.append(" ".join(w))
        y.append(float(a and b or c))
    h, doc = fm.terms(pa.array(texts, pa.large_string()), 0, len(texts))
    single = fm.choose_terms(h, doc, np.array(y), fm.MAX_TERMS, fm.MIN_DOCS)
    assert hashes("vile")[0] in single and not {hashes("group")[0], hashes("partner")[0]} & set(single)
    m = fm.fit(h, doc, np.array(y), epochs=120)
    s = {t: fm.sigmoid(m.margin(*m.active(hashes(t), np.zeros(len(hashes(t)), np.int64)), 1))[0]
         for t in ("f1 f2 group", "f1 f2 partner", "f1 f2", "f1 f2 vile", "f1 f2 group partner")}
    assert min(s["f1 f2 group partner"], s["f1 f2 vile"]) > 0.5
    assert max(s["f1 f2 group"], s["f1 f2 partner"], s["f1 f2"]) < 0.5


def test_pairs_against_brute_force(monkeypatch):
    monkeypatch.setattr(fm, "PAIR_BLOCK", 7)
    r = np.random.default_rng(8)
    x = r.random((400, 30)) < r.uniform(0.02, 0.6, 30)
    p = r.uniform(0.05, 0.3, 400)
    y = (r.random(400) < np.where(x[:, 3] & x[:, 20] | x[:, 5] & x[:, 6], 0.9, p)).astype(float)
    doc, term = np.nonzero(x)
    often = x.sum(0) >= 4
    limit, want = math.log(often.sum() * (often.sum() - 1) / 2), set()
    for i in range(30):
        for j in range(i):
            both = x[:, i] & x[:, j]
            n = both.sum()
            if n >= 4 and fm.gains(n, y[both].sum(), p[both].mean()) > limit:
                want |= {i, j}
    assert want and set(fm.choose_pairs(term.astype(np.uint64), doc, y, p, 100, 4).tolist()) == want


def test_held_out_fold_is_crc32(spark):
    import zlib
    from pyspark.sql import functions as F
    got = spark.range(200).select("id", fm.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in got)


def test_training_never_sees_the_held_out_fold_and_repeats(spark, make_docs):
    import zlib
    bad = "you awful fool and scoundrel"
    rows = [(i, text_of(i, 40) + (bad if i % 3 == 0 else "")) for i in range(150)]
    docs = make_docs(rows)
    honest = [(i, int(i % 3 == 0)) for i, _ in rows]
    lying = [(i, y if zlib.crc32(str(i).encode()) % 5 else 1 - y) for i, y in honest]
    a, b = (fm.train(docs, labels_of(spark, x, "toxic")) for x in (honest, lying))
    assert (a.known == b.known).all() and (a.weight == b.weight).all() and (a.factor == b.factor).all()
    got = fm.score(docs, a).collect()
    held = [(r.predicted, int(r.doc_id % 3 == 0)) for r in got if r.held_out]
    assert len(held) > 15 and all(p == y for p, y in held)


def test_toxicity_odd_rows(spark, make_docs):
    rows = [(1, None), (2, ""), (None, "x"), (4, "y " * 50000), (4, "y " * 50000)]
    got = fm.score(make_docs(rows), fm.train(make_docs(rows), labels_of(spark, [(4, 1), (9, None)], "toxic"))).collect()
    assert len(got) == 5 and all(0 <= r.score < 1e-6 and r.predicted == 0 for r in got)
    assert fm.score(make_docs([]), fm.train(make_docs([]), labels_of(spark, [], "toxic"))).count() == 0


def test_toxicity_query(spark):
    import __spark_entry__ as E
    got = E.queries()["op3_toxicity_fm"](spark, SF_CHECK).collect()
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF_CHECK}/labels.parquet").collect()}
    seen = [(r.predicted, truth[r.doc_id]) for r in got if not r.held_out and r.doc_id in truth]
    clean = [p for p, t in seen if t == 0]
    assert len(got) == 1000 and np.mean(clean) <= 0.01
    assert {r.predicted for r in got} == {0, 1} and all((r.score >= 0.5) == (r.predicted == 1) for r in got)
