import math
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from tallyframe.llm import license_scan as ls, mixing, url_filter as uf
from tests.conftest import SF_CHECK, SF_SMALL
from tests.llm import brute
from tests.llm.conftest import text_of


def targets_by_rounds(sizes, weights=(3, 1, 2)):
    """Reshare the excess by weight until no source is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s.encode() if s is not None else b""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total = Fraction(3, 2) * sum(sizes.values())
    capped = set()
    while True:
        free = [s for s in order if s not in capped]
        room = total - sum(2 * sizes[s] for s in capped)
        share = {s: room * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            return {**{s: 2 * sizes[s] for s in capped}, **share}
        capped |= over


@pytest.mark.parametrize("seed", range(4))
def test_targets_against_rounds(spark, seed):
    r = random.Random(seed)
    sizes = {s: r.randrange(1, 10 ** r.randrange(1, 6)) for s in ["a", "B", "é", "z", "", "𝄞", None][:3 + seed]}
    got = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()
    want = targets_by_rounds(sizes)
    assert {r.source for r in got} == set(want)
    assert all(math.isclose(r.target, float(want[r.source]), rel_tol=1e-9) for r in got)


def check_mix(rows, got):
    size = Counter()
    for r in rows:
        size[r[2]] += len(brute.words(r[1]))
    want = targets_by_rounds(size) if sum(size.values()) else {s: 0 for s in size}
    taken = Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.source_size == size[r.source]
        assert math.isclose(r.target, float(want[r.source]), rel_tol=1e-9, abs_tol=1e-9)
        taken[r.source] += r.taken
    for s in size:
        assert abs(taken[s] - want[s]) <= 1


def test_mix_meets_targets_and_repeats(make_docs):
    rows = [(i, text_of(i, 3 + i % 90), f"s{(i * i) % 5}") for i in range(400)]
    rows += [(1000 + i, text_of(i, 40), "hot") for i in range(300)]
    rows += [(2000, None, "s1"), (2001, "", None), (2002, "a b c", None), (None, "x y", "s2"), (7, "again", "s0"),
             (7, "again", "s0"), (2003, "", "void")]
    docs = make_docs(rows)
    got = mixing.mix(docs).collect()
    check_mix(rows, got)
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(docs.repartition(5), slices=16).collect()))
    # in the fractional epoch a document that gives its words has a smaller key than one that does not
    for s in ("hot", "s1"):
        mine = sorted((r for r in got if r.source == s and r.size), key=lambda r: key_of(r.doc_id, r.weight))
        extra = [r.taken % r.size if r.taken % r.size else (r.size if r.taken == max(x.taken // x.size for x in mine) * r.size else 0)
                 for r in mine]
        full = [r.taken // r.size for r in mine]
        assert full == sorted(full, reverse=True) and len([e for e in extra if 0 < e < 1]) == 0


def key_of(doc_id, weight):
    import hashlib
    u = (int(hashlib.md5(f"mix:{doc_id}".encode()).hexdigest()[:13], 16) + 0.5) / 16 ** 13
    return -math.log(u) / weight


def test_heavier_documents_come_first_more_often(make_docs, spark):
    rows = [(i, "w " * 50 + ("# " * 30 if i % 2 else ""), "s") for i in range(600)] + [(10 ** 6, "big " * 90000, "t")]
    got = [r for r in mixing.mix(make_docs(rows)).collect() if r.source == "s"]
    assert {round(r.weight, 2) for r in got if r.doc_id % 2 == 0} == {1.0}
    mean = {k: np.mean([key_of(r.doc_id, r.weight) for r in got if r.doc_id % 2 == k]) for k in (0, 1)}
    assert mean[0] < mean[1] / 2


def test_take_documents(make_docs):
    rows = [(i, text_of(i, 5 + i % 30), f"s{i % 3}") for i in range(60)] + [(90, None, "s0"), (3, text_of(3, 8), "s0")]
    docs = make_docs(rows).withColumnRenamed("lang", "taken")
    mixed = mixing.mix(docs)
    out = mixing.take_documents(docs, mixed)
    assert out.columns == docs.columns
    got = Counter()
    whole = {r[1] for r in rows}
    for r in out.collect():
        got[r.doc_id] += len(brute.words(r.text))
        assert r.text in whole or any(t and t.startswith(r.text) for t in whole)
    want = Counter()
    for r in mixed.collect():
        want[r.doc_id] += r.taken
    assert +got == +want


def test_mix_empty(make_docs):
    assert mixing.mix(make_docs([])).count() == 0


def test_mix_query(spark):
    import __spark_entry__ as E
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    check_mix(rows, E.queries()["op6_mixing"](spark, SF_SMALL).collect())


# --- URLs ----------------------------------------------------------------------------

def parts(url):
    head, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    tail = rest[cut:]
    end = min([i for i in (tail.find(c) for c in "?#") if i >= 0], default=len(tail))
    return brute.ascii_lower(rest[:cut]), tail[:end]


def rule_of(host, path):
    best = None
    for rule, verdict in uf.RULES:
        h, s, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(s + p) and (best is None or len(rule) > len(best[0])):
            best = rule, verdict
    return best or (None, None)


ODD_URLS = [None, "", "no scheme", "://", "http://", "HTTP://WWW.Example.NET/en/x?a=/de/#f", "http://net/", "http://x.net",
            "http://xnet/", "http://a.example.com/de", "http://a.example.com/de/", "ftp://b.ORG/fr/ü?://q",
            "a://b?c://d.net/en/", "http://example.net/EN/", "x\n://é.org/fr/\nb"]


def test_hosts_paths_and_rules(spark):
    rows = [(i, u) for i, u in enumerate(ODD_URLS)] + [(None, "http://q.net/")]
    got = uf.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert len(got) == len(rows)
    url = dict(rows)
    for r in got:
        host, path = parts(url[r.page_id])
        rule, verdict = rule_of(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if rule else r.verdict in ("allow", "block")


def model_text(host, path, order):
    t = brute.ascii_lower(host + path)
    t = "".join("0" if c in "123456789" else c for c in t)
    return "^" * order + "".join(c if c in "abcdefghijklmnopqrstuvwxyz0./-_%" else "~" for c in t) + "$"


class Markov:
    def __init__(self, texts, order):
        self.n, self.order = Counter(), order
        for t, k in texts:
            for i in range(order, len(t)):
                for j in range(order + 1):
                    self.n[t[i - j:i + 1]] += k
        self.total, self.kinds = Counter(), Counter()
        for g, k in self.n.items():
            if k:
                self.total[len(g), g[:-1]] += k
                self.kinds[len(g), g[:-1]] += 1

    def p(self, gram):
        low = self.p(gram[1:]) if len(gram) > 1 else 1 / (len(uf.ALPHABET) + 1)
        key = len(gram), gram[:-1]
        if not self.total[key]:
            return low
        return (self.n[gram] + self.kinds[key] * low) / (self.total[key] + self.kinds[key])


def test_ratios_and_cut_against_brute_force(spark):
    import __spark_entry__ as E
    from pyspark.sql import functions as F
    pages = spark.read.parquet(f"{SF_CHECK}/pages.parquet").collect()
    k = uf.ORDER
    texts = {}
    for r in pages:
        host, path = parts(r.url)
        t = texts.setdefault(model_text(host, path, k), {"allow": 0, "block": 0, None: 0})
        t[rule_of(host, path)[1]] += 1
    unseen = {r.t for r in spark.createDataFrame([(t,) for t in texts], "t string")
              .where(F.pmod(F.xxhash64("t"), F.lit(uf.FOLDS)) == 0).collect()}
    good, bad = (Markov([(t, n[v]) for t, n in texts.items() if t not in unseen], k) for v in ("allow", "block"))
    ratio = {t: np.mean([math.log(good.p(t[i - k:i + 1]) / bad.p(t[i - k:i + 1])) for i in range(k, len(t))])
             for t in texts}
    stat = []
    for v in ("allow", "block"):
        x = [ratio[t] for t in texts if t in unseen for _ in range(texts[t][v])]
        stat.append((np.mean(x), np.std(x) + 1e-6))
    (ma, sa), (mb, sb) = stat
    cut = (ma * sb + mb * sa) / (sa + sb)
    by = {r.page_id: r for r in pages}
    got = E.queries()["op9_url_filter"](spark, SF_CHECK).collect()
    assert len(got) == len(pages)
    for r in got:
        host, path = parts(by[r.page_id].url)
        t = model_text(host, path, k)
        assert math.isclose(r.ratio, ratio[t], rel_tol=1e-9, abs_tol=1e-12)
        rule, verdict = rule_of(host, path)
        assert r.verdict == (verdict or ("allow" if ratio[t] >= cut else "block"))
    assert ma > cut > mb


@pytest.mark.parametrize("n", [1, 2, 3])
def test_few_judged_urls_still_give_a_cut(spark, n):
    rows = ([(i, f"http://wiki{i}.org/fr/science/history/{i}") for i in range(n)]
            + [(10 + i, f"http://casino{i}.net/win/poker/bonus{i}") for i in range(n)]
            + [(20, "http://pokerwin.com/win/poker/bonus"), (21, "http://wiki.com/fr/science/history")])
    got = {r.page_id: r.verdict for r in uf.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[20] == "block" and got[21] == "allow"
    texts = spark.createDataFrame([(f"t{i}", int(i % 2), int(1 - i % 2), h) for i, h in enumerate([5, 10, 6, 15, 7, 1])],
                                  "text string, allowed long, blocked long, hash long")
    fold = {r.text: r.unseen for r in uf.with_fold(texts, 5).collect()}
    # Accepted: 10, 15, 1; rejected: 5, 6, 7.
    assert fold == {"t0": True, "t1": True, "t2": False, "t3": True, "t4": False, "t5": False}


def test_urls_without_both_groups_and_empty(spark):
    one = spark.createDataFrame([(1, "http://a.net/x"), (2, "http://b.com/y")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in uf.judge(one).collect()} == {1: "block", 2: "allow"}
    assert uf.judge(one.limit(0)).count() == 0


def test_native_plans(spark, make_docs):
    """Mixing and URL filter stay in DataFrame expressions."""
    docs = make_docs([(1, "a b", "s"), (2, "c", "t")])
    pages = spark.createDataFrame([(1, "http://a.net/x")], "page_id long, url string")
    for df in (mixing.mix(docs), mixing.take_documents(docs, mixing.mix(docs)), uf.judge(pages)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_url_models_are_planned_in_small_steps(spark, monkeypatch):
    """The driver never holds more than one order of the models in a plan."""
    from pyspark.sql import DataFrameWriter
    plans, write = [], DataFrameWriter.parquet

    def parquet(self, path, *args, **kwargs):
        plans.append(self._df._jdf.queryExecution().optimizedPlan().toString())
        return write(self, path, *args, **kwargs)
    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    pages = spark.createDataFrame([(1, "http://a.net/x"), (2, "http://b.org/fr/y"), (3, "http://c.com/z")],
                                  "page_id long, url string")
    plans.append(uf.judge(pages)._jdf.queryExecution().optimizedPlan().toString())
    assert len(plans) > uf.ORDER
    assert max(p.count("Join ") for p in plans) <= 2 and max(p.count("Aggregate ") for p in plans) <= 3


# --- licenses ---------------------------------------------------------------------------

def naive_hits(text, names=None):
    """Templates whose words occur in a row in the text."""
    import re
    w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", brute.ascii_lower(text))
    out = Counter()
    for name, t in (names or ls.TEMPLATES).items():
        k = re.findall(r"[a-z0-9\x80-\U0010ffff]+", brute.ascii_lower(t))
        out[name] += sum(w[i:i + len(k)] == k for i in range(len(w)))
    return out


def test_license_query_finds_every_notice(spark):
    import __spark_entry__ as E
    got = E.queries()["op7_license_scan"](spark, SF_CHECK).collect()
    found = {}
    for r in got:
        found.setdefault(r.doc_id, Counter())[r.license] += r.coverage == 1
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF_CHECK}/documents.parquet").collect()}
    for d, t in texts.items():
        assert +naive_hits(t) == +found.get(d, Counter()), d
    for r in got:
        assert texts[r.doc_id][r.start_char:r.end_char] == r.span


def test_changed_notices_and_spans(make_docs):
    t = ls.TEMPLATES["MIT-permission"]
    w = t.split()
    changed = " ".join(w[:20] + ["slightly", "other"] + w[22:40] + w[41:])
    rows = [(1, "é é " + changed + " the end"), (2, " ".join(w[:30])), (3, None), (4, ""), (None, t), (6, t + "\n" + t),
            (7, "Released under the MIT License. " * 4), (8, text_of(1, 300)), (9, "under the terms of nothing")]
    got = ls.scan(make_docs(rows)).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    text = dict(rows)
    n = len(ls._hashes(t))
    assert [(r.license, r.matched_words) for r in by[1]] == [("MIT-permission", n - 3)]
    assert by[1][0].span == text[1][by[1][0].start_char:by[1][0].end_char] and by[1][0].span.startswith("Permission")
    assert [r.coverage for r in by[None]] == [1.0] and [r.coverage for r in by[6]] == [1.0, 1.0]
    assert len(by[7]) == 4 and not {2, 3, 4, 8, 9} & by.keys()
    assert ls.scan(make_docs([])).count() == 0
    with pytest.raises(ValueError):
        ls.Index({"x": "two words"})


CC = "This work is licensed under a Creative Commons Attribution{} International License."
GNU = "This work is licensed under the GNU {}."


NAMED = [
    ("Released under an MIT License.", ["MIT"]), ("Released the MIT License", ["MIT"]),
    ("Released under the new MIT License.", ["MIT"]), ("Released under the MIT and Apache License", ["MIT"]),
    ("Released under the BSD License.", []), ("Released under the foo License.", []),
    ("Licensed under the Apache License, Version 1.1", ["Apache-1.1"]),
    ("Licensed under the Apache License, Version 2", ["Apache-2.0"]),
    ("Licensed under the Apache License, v2.0", ["Apache-2.0"]),
    ("Licensed under the Apache License, Version 2.0.1", []),
    (GNU.format("General Public License, version 2"), ["GPL-2.0"]),
    (GNU.format("General Public License, version 2.0"), ["GPL-2.0"]),
    (GNU.format("General Public License, version 3"), ["GPL-3.0"]),
    (GNU.format("General Public Licence, version 3 (or later)"), ["GPL-3.0"]),
    (GNU.format("General Public License, version 7"), []),
    (GNU.format("Lesser General Public License, version 2.1"), ["LGPL-2.1"]),
    (GNU.format("Lesser General Public License, version 3"), ["LGPL-3.0"]),
    (GNU.format("Affero General Public License, version 3"), ["AGPL-3.0"]),
    (GNU.format("Free Documentation License, version 1.3"), ["GFDL-1.3"]),
    ("This work is licensed under the Mozilla Public License, version 2.0.", []),
    (CC.format(" 4.0"), ["CC-BY-4.0"]), (CC.format("-NonCommercial 4.0"), ["CC-BY-NC-4.0"]),
    (CC.format("-NonCommercial-ShareAlike 4.0"), ["CC-BY-NC-SA-4.0"]), (CC.format("-ShareAlike 4.0"), ["CC-BY-SA-4.0"]),
    (CC.format("-NoDerivatives 4.0"), ["CC-BY-ND-4.0"]), (CC.format("-NoDerivs 4.0"), ["CC-BY-ND-4.0"]),
    (CC.format("-Non-Commercial 4.0"), ["CC-BY-NC-4.0"]), (CC.format(" 3.0"), ["CC-BY-3.0"]), (CC.format(" 9.0"), []),
    ("Licensed under CC BY-NC-SA 3.0", ["CC-BY-NC-SA-3.0"]), ("Licensed under CC BY 4.0.", ["CC-BY-4.0"]),
    (ls.TEMPLATES["GPL-notice"].replace("GNU", "GNU Lesser"), ["LGPL-notice"]),
    (ls.TEMPLATES["GPL-notice"].replace("GNU", "GNU Affero"), ["AGPL-notice"]),
    (ls.TEMPLATES["GPL-notice"].replace("program", "library"), ["GPL-notice"]),
    (ls.TEMPLATES["MIT-permission"].replace("Software", "Library"), ["MIT-permission"])]


def test_names_need_their_own_words(make_docs):
    rows = [(i, f"Version 2 of a page. {t}\nMore by the author, 3 pages.") for i, (t, _) in enumerate(NAMED)]
    got = {}
    for r in ls.scan(make_docs(rows).coalesce(2)).collect():
        got.setdefault(r.doc_id, []).append(r.license)
    assert [(t, got.get(i, [])) for i, (t, _) in enumerate(NAMED)] == NAMED


def test_every_text_of_enough_coverage_is_a_candidate():
    """A quarter of the words lost or replaced, wherever it is, leaves a hit on the diagonal."""
    r = np.random.default_rng(5)
    index = ls.Index([*ls.TEMPLATES.items(), *ls.FORMS])
    for t, w in enumerate(index.words):
        n = len(w)
        lost = n - math.ceil(ls.MIN_COVERAGE * n)
        spread = np.unique(np.round(np.linspace(0, n - 1, lost + 2)[1:-1]).astype(int))
        for at in [spread, spread[::-1][:lost], *(r.choice(n, lost, replace=False) for _ in range(20))]:
            x = w.copy()
            x[at] = np.arange(len(at), dtype=np.uint64)
            g, first = ls.windows(x, np.zeros(n, np.int64), index.gram)
            hit, owner, place = index.hits(g)
            assert ((owner == t) & (first[hit] == place)).any(), index.names[t]


def test_alignment_against_full_table():
    r = np.random.default_rng(2)
    for _ in range(60):
        t = r.integers(0, 6, 9)
        x = np.concatenate([r.integers(0, 6, 3), t[:4], r.integers(0, 6, int(r.integers(0, 3))), t[4:], r.integers(0, 6, 3)])
        got, a, z = ls.align(t, x, 3, 20)
        best = np.zeros((len(t) + 1, len(x) + 1))
        for i in range(1, len(t) + 1):
            for j in range(1, len(x) + 1):
                best[i, j] = max(0, best[i - 1, j - 1] + (2 if t[i - 1] == x[j - 1] else -1), best[i - 1, j] - 1,
                                 best[i, j - 1] - 1)
        narrow = ls.align(t, x[a:z], 0, 20)
        assert got == narrow[0] and 2 * got >= best.max() >= 2 * got - (len(t) + len(x))


def test_winnowing_guarantee():
    r = np.random.default_rng(4)
    h = r.integers(0, 2 ** 62, 200).astype(np.uint64)
    kept = ls.winnow(h, 4)
    assert np.diff(kept).max() <= 4 and kept[0] < 4 and kept[-1] >= 196
    assert list(ls.winnow(h[:2], 4)) == [int(np.argmin(h[:2]))]
