"""The pipeline against its stages' definitions, and the catalogue's entries."""

import re
from collections import Counter

import corpus_pipeline
from tallyframe.llm import mixing, quality_crf
from tests.conftest import SF_CHECK
from tests.llm import brute


def test_catalogue():
    import __spark_entry__ as E
    names = E.queries()
    assert {int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))} == set(range(1, 14)) and "pipeline" in names
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality rules", "line dedup", "n-gram Jaccard join", "mixing sources", "packing"]


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    labels = spark.read.parquet(f"{SF_CHECK}/labels.parquet")
    columns = docs.columns
    kept = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r.doc_id, r.text, r.source) for r in docs.collect()]
        stage(spark, docs, SF_CHECK).write.parquet(str(tmp_path / str(i)))
        after = spark.read.parquet(str(tmp_path / str(i)))
        if i < 4:
            assert after.columns == columns
        rows = after.collect()
        if i == 0:
            field = quality_crf.train_field(docs, labels)
            want = {r.doc_id for r in quality_crf.quality_measures(docs, field).collect() if r.kept}
            assert {r.doc_id for r in rows} == want and len(rows) == len(want)
            bad = {r.doc_id for r in labels.where("quality = 0").collect()}
            assert not bad & want
        elif i == 1:
            want = {d: t for d, _, _, t in brute.line_dedup([r[:2] for r in before])}
            assert {r.doc_id: r.text for r in rows} == want
        elif i == 2:
            text = dict(r[:2] for r in before)
            low = {c for _, _, c in quick_components(text)}
            assert sorted(r.doc_id for r in rows) == sorted(low)
        elif i == 3:
            got = Counter()
            for r in rows:
                got[r.doc_id] += len(brute.words(r.text))
            want = {r.doc_id: r.taken for r in mixing.mix(docs).collect() if r.taken}
            assert got == want
        else:
            from tallyframe.llm._tokens import encoder
            ids, _ = encoder().encode([r[1] or "" for r in before])
            assert sum(r.length for r in rows) == len(ids)
        if i < 4:
            assert all(r.n_chars == len(r.text or "") for r in rows)
        docs = after
        kept.append(len(rows))
    assert kept[0] > kept[2] > 0


def quick_components(text):
    """Components of the documents that share any shingle (an index over all)."""
    sets = {d: brute.shingle_set(t) for d, t in text.items()}
    index = {}
    for d, s in sets.items():
        for x in s:
            index.setdefault(x, []).append(d)
    parent = {d: d for d in sets}

    def find(d):
        while parent[d] != d:
            d = parent[d]
        return d
    for a, b in {(x, y) for held in index.values() for x in held for y in held if x < y}:
        both = len(sets[a] & sets[b])
        if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return [(d, len(s), find(d)) for d, s in sets.items()]
