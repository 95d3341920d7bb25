"""Containment of names in texts: any kind of name, rows without ids, OR of names."""

import random

from pyspark.sql import functions as F

from tallyframe.operators import enrich

NAMES = ["saka", "Bukayo Saka", "b saka", "a", "é", "--", "o'neil", " saka", "x y z", "De  Bruyne", "de bruyne",
         "ño", "12", "a1 b2", "the the the", "kevin de bruyne", "...", "an-na", "ab c"]


def texts(n, seed=3):
    r = random.Random(seed)
    bits = NAMES + ["lorem", "Sakar", "bb saka!", "xx y zz", "De  BruyneX", "é", ".", ", ", "  ", "ann-nab", "zab cd"]
    return [" ".join(r.choice(bits) for _ in range(r.randrange(1, 9))) for _ in range(n)]


def test_every_kind_of_name_and_null_ids(spark):
    docs = [(None if i % 3 == 0 else i % 11, t) for i, t in enumerate(texts(150))] + [(5, None), (None, "")]
    docs += [docs[1]] * 40
    names = [(None if i % 4 == 0 else i, n) for i, n in enumerate(NAMES)] + [(99, ""), (98, None)]
    nm = spark.createDataFrame(names, "nid int, name string")
    dd = spark.createDataFrame(docs, "did int, body string")
    want = {(n, d) for n, a in names for d, t in docs if a and t and a.lower() in t.lower()}
    for k in (2, 3):
        got = [tuple(r) for r in enrich.containment_join(nm, dd, "nid", "name", "did", "body", k=k).collect()]
        assert set(got) == want and len(got) == len(want)


def test_short_or_full_name_over_title_and_summary(spark):
    people = [("Saka", "Bukayo", "Saka", 1), ("KDB", "Kevin", "De Bruyne", None), (None, None, None, 3),
              (" ", "", "Oneword", 4), ("Nobody", "No", "Body", None), ("Saka", "Bukayo", "Saka", 1)]
    news = [(1, "Bukayo Saka", "starts", "a"), (None, "kdb and saka", "again", "b"), (3, "Kevin", "De Bruyne out", "c"),
            (None, "title oneword", None, "d"), (3, "Kevin", "De Bruyne out", "c"), (6, None, "nothing", "e")]
    ent = spark.createDataFrame(people, "short string, first string, second string, id int")
    art = spark.createDataFrame(news, "aid int, title string, summary string, source string")
    rows, matches = enrich.entity_articles(ent, art, "short", "first", "second")
    got = sorted(((r.short or "", r.id or 0), [(x.aid, x.title) for x in r.news_articles]) for r in enrich.attach_articles(
        rows, matches, ["source"], ["aid", "title"]).collect())
    saka = [(1, "Bukayo Saka"), (None, "kdb and saka")]
    assert got == [(("", 3), []), ((" ", 4), [(None, "title oneword")]),
                   (("KDB", 0), [(None, "kdb and saka"), (3, "Kevin"), (3, "Kevin")]),
                   (("Nobody", 0), []), (("Saka", 1), saka), (("Saka", 1), saka)]
    empty, none = enrich.entity_articles(ent, art.where(F.lit(False)), "short", "first", "second")
    assert [r.news_articles for r in enrich.attach_articles(empty, none, ["source"], ["aid"]).collect()] == [[]] * 6


def test_names_with_separators_on_a_side(spark):
    names = [" an", "an ", " an ", "an", "o c", "ab  de", "xab de", "ab dex", "a-1", "ß é"]
    docs = ["ban", "an x", "x an", "x an y", "xan y", "y anx", "foo cab de", "ab  de", "xxab dexx", "qab de", "a b", "b a-1",
            "1a-12", "Maß élan", "ß  é", "o c", "oo cc", ""]
    nm = spark.createDataFrame(list(enumerate(names)), "nid int, name string")
    dd = spark.createDataFrame(list(enumerate(docs)), "did int, body string")
    want = {(n, d) for n, a in enumerate(names) for d, t in enumerate(docs) if a in t.lower()}
    for k in (1, 2, 3):
        assert {tuple(r) for r in enrich.containment_join(nm, dd, "nid", "name", "did", "body", k=k).collect()} == want


def test_the_texts_are_read_for_their_words_once(spark, monkeypatch):
    asked = []
    real = enrich.F.regexp_extract_all
    monkeypatch.setattr(enrich.F, "regexp_extract_all", lambda c, *a: (asked.append(str(c)), real(c, *a))[1])
    nm = spark.createDataFrame(list(enumerate(NAMES)), "nid int, name string")
    dd = spark.createDataFrame(list(enumerate(texts(20))), "did int, body string")
    enrich.containment_join(nm, dd, "nid", "name", "did", "body")
    assert sum("_text" in c for c in asked) == 2  # the words, and what stands around the separators


def _rows_out(plan, found):
    """(node, rows) of every node of an executed plan."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        return _rows_out(plan.executedPlan(), found)
    rows = plan.metrics().get("numOutputRows")
    if rows.isDefined():
        found.append((name, rows.get().value()))
    inner = [plan.plan()] if name.endswith("QueryStage") or "QueryStage" in name else []
    kids = plan.children()
    for p in inner + [kids.apply(i) for i in range(kids.size())]:
        _rows_out(p, found)
    return found


def test_long_names_meet_texts_by_runs_of_words(spark):
    """every text holds every word of the names, but few hold a name."""
    r = random.Random(8)
    words = [f"w{i}" for i in range(30)]
    names = [" ".join(r.choice(words) for _ in range(6 + i % 3)) for i in range(40)] + ["the " * n + "the" for n in (2, 3, 4, 5, 9)]
    docs = [" ".join(r.sample(words, 30)) + " the the" for _ in range(60)]
    docs += [f"so {n.upper()}-x" for n in names[:45:3]] + ["the " * 30, "the the the the the", "W1. " + names[1].replace(" ", "  ")]
    nm = spark.createDataFrame(list(enumerate(names)), "nid int, name string")
    dd = spark.createDataFrame(list(enumerate(docs)), "did int, body string")
    got = enrich.containment_join(nm, dd, "nid", "name", "did", "body")
    want = {(n, d) for n, a in enumerate(names) for d, t in enumerate(docs) if a.lower() in t.lower()}
    pairs = [tuple(x) for x in got.collect()]
    assert set(pairs) == want and len(pairs) == len(want) > 20
    made = [n for node, n in _rows_out(got._jdf.queryExecution().executedPlan(), []) if node == "ObjectHashAggregate"]
    assert made and max(made) < 4 * len(want) + len(docs)  # 40 names in each of 60 texts before


def test_runs_and_the_sieve_lose_no_row(spark):
    df = spark.createDataFrame([(1, list("abcab")), (2, ["a"]), (3, []), (4, None)], "i int, w array<string>")
    assert sorted(r.i for r in enrich._runs(df, "w", 2).collect()) == [1] * 4
    assert sorted(r.i for r in enrich._runs(df, "w", 1).collect()) == [1] * 5 + [2]
    g = enrich._runs(df, "w", 2)
    ab = enrich._runs(spark.createDataFrame([(["a", "b"],)], "w array<string>"), "w", 2)
    assert g.join(ab, "_g").count() == 2 and enrich._sifted(g, "_g", ab).count() >= 2
    assert enrich._sifted(g, "_g", ab.limit(0)).count() == 0
