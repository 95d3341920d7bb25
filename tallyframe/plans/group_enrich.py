"""Catalogue entries: news, containment, enrichment merge/contracts/batches,
profile text and the injected-function boundaries (S5 S6 J5 U5 J7 J15 Q7 Q8
P24 P25 P26 W10 X2 X3 X4)."""

from __future__ import annotations


import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.operators import enrich
from tallyframe.plans.catalog import query
from tallyframe.plans.context import Context
from tallyframe.plans.oracle import oracle
from tallyframe.plans.oracle_views import view
from tallyframe.sources import standins

AS_OF = "2024-01-07"
WINDOW_DAYS = 3
# Fixed values of the stand-in binding: none of the product's football
# keywords occurs in the supplied prose, so the binding filters on the
# licence vocabulary that does (the operator takes any keyword list).
STANDIN_KEYWORDS = ["license", "copyright"]

view("v_articles", (), f"""
SELECT doc_id, text AS summary, '' AS title, source, lang,
       CAST(DATE '{standins.ARTICLE_BASE_DATE}' + CAST(doc_id % 7 AS INTEGER) AS DATE) AS date,
       CAST(DATE '{standins.ARTICLE_BASE_DATE}' + CAST(doc_id % 7 AS INTEGER)
            + CASE WHEN doc_id % 9 = 0 THEN 1 ELSE 0 END AS DATE) AS published
FROM documents""")


@query("article_filter")
def _(c: Context):
    """Articles of the last 3 days, date-consistent, mentioning a keyword."""
    a = enrich.relevant_articles(standins.articles(c.t), ["title", "summary"], "date", "published",
                                 AS_OF, WINDOW_DAYS, STANDIN_KEYWORDS)
    return a.select("doc_id", "source", "date")


_KW = " OR ".join(f"strpos(lower(title || ' ' || summary), '{k}') > 0" for k in STANDIN_KEYWORDS)
oracle("article_filter", f"""
SELECT doc_id, source, date FROM v_articles
WHERE date > DATE '{AS_OF}' - INTERVAL {WINDOW_DAYS} DAY AND date <= DATE '{AS_OF}'
  AND published = date AND ({_KW})""", "v_articles")


@query("article_match")
def _(c: Context):
    """Benchmark passages contained in documents."""
    return enrich.containment_join(c.t.benchmark, c.t.documents, "item_id", "text", "doc_id", "text")


@query("article_match_blocked")
def _(c: Context):
    """The same pairs with blocks on longer grams (four characters)."""
    return enrich.containment_join(c.t.benchmark, c.t.documents, "item_id", "text", "doc_id", "text", k=4)


_MATCH_SQL = """
SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d
  ON length(b.text) > 0 AND strpos(lower(d.text), lower(b.text)) > 0"""
oracle("article_match", _MATCH_SQL)
oracle("article_match_blocked", _MATCH_SQL)

# --- J7 ----------------------------------------------------------------------------

_FIELDS = {"quality": ["score", "label"], "toxic": ["score", "label"]}


@query("enrichment_merge")
def _(c: Context):
    """Per-document enricher outputs merged with prefixed columns."""
    base = c.t.documents.select("doc_id", "source")
    return enrich.merge_enrichments(base, standins.enrichment_results(c.t), "doc_id",
                                    ["quality", "toxic"], _FIELDS)


oracle("enrichment_merge", """
SELECT d.doc_id, d.source, l.quality AS quality_score,
       CASE WHEN l.doc_id IS NULL THEN NULL WHEN l.quality = 1 THEN 'good' ELSE 'poor' END AS quality_label,
       CASE WHEN l.doc_id % 11 = 0 THEN NULL ELSE l.toxic END AS toxic_score,
       CASE WHEN l.doc_id IS NULL OR l.doc_id % 11 = 0 THEN NULL
            WHEN l.toxic = 1 THEN 'toxic' ELSE 'clean' END AS toxic_label
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")

# --- X2 + Q7 + Q8 ----------------------------------------------------------------------


def injury_enricher(batch: list[dict]) -> list[dict]:
    """A deterministic stand-in for the injected enricher call (X2): one
    output per input item, in order.  Some outputs break the contract on
    purpose (risk 11, empty reasoning, an unknown key)."""
    out = []
    for it in batch:
        o = {"risk_score": int(it["quality"]) * 6 + int(it["toxic"]) * 5,
             "reasoning": "" if it["doc_id"] % 17 == 0 else f"q{it['quality']}t{it['toxic']}",
             "injury_type": None, "sources": []}
        if it["doc_id"] % 13 == 0:
            o["extra"] = 1
        out.append(o)
    return out


def summary_enricher(batch: list[dict]) -> list[dict]:
    trends = ["improving", "stable", "declining", "unknown"]
    return [{"summary": f"Document {it['doc_id']} from {it['source']} in {it['lang']}",
             "form_trend": trends[it["doc_id"] % 4],
             "confidence": (it["doc_id"] % 12) / 10.0} for it in batch]


_RAW = T.StructType([T.StructField("raw", T.StringType())])


def _validated(c: Context):
    lab = c.t.labels.join(c.t.documents.select("doc_id", "source", "lang"), "doc_id", "inner")
    inj = enrich.enrich(lab, injury_enricher, ["doc_id", "quality", "toxic"], 10, _RAW, "doc_id")
    inj = inj.select("doc_id", F.lit("injury_signal").alias("enricher"),
                     enrich.validate_output(F.col("enrichment_json"), enrich.INJURY_SCHEMA,
                                            enrich.injury_checks).alias("out"))
    sm = enrich.enrich(lab, summary_enricher, ["doc_id", "source", "lang"], 10, _RAW, "doc_id")
    sm = sm.select("doc_id", F.lit("player_summary").alias("enricher"),
                   enrich.validate_output(F.col("enrichment_json"), enrich.SUMMARY_SCHEMA,
                                          enrich.summary_checks).alias("out"))
    return inj, sm


@query("enrichment_validate")
def _(c: Context):
    """Injected enricher over batches, outputs validated by contract."""
    inj, _sm = _validated(c)
    return inj.select("doc_id", F.col("out").isNotNull().alias("is_valid"),
                      F.col("out.risk_score").alias("risk_score"))


_INJ_OK = "(quality * 6 + toxic * 5 <= 10 AND doc_id % 17 <> 0 AND doc_id % 13 <> 0)"
oracle("enrichment_validate", f"""
SELECT doc_id, {_INJ_OK} AS is_valid,
       CASE WHEN {_INJ_OK} THEN CAST(quality * 6 + toxic * 5 AS INTEGER) END AS risk_score
FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)""")


@query("enrichment_pass_rate")
def _(c: Context):
    """Q8: pass rate per enricher (rounded to 4 dp)."""
    inj, sm = _validated(c)
    both = (inj.select("enricher", F.col("out").isNotNull().alias("ok"))
               .unionByName(sm.select("enricher", F.col("out").isNotNull().alias("ok"))))
    return enrich.pass_rate(both, "enricher", "ok")


oracle("enrichment_pass_rate", f"""
SELECT enricher, CAST(count_if(ok) AS BIGINT) AS valid, CAST(count_if(NOT ok) AS BIGINT) AS invalid,
       round_even(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END)::DOUBLE, 4) AS pass_rate FROM (
  SELECT 'injury_signal' AS enricher, {_INJ_OK} AS ok FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)
  UNION ALL
  SELECT 'player_summary', length('Document ' || CAST(l.doc_id AS VARCHAR) || ' from ' || d.source || ' in ' || d.lang) >= 20
         AND l.doc_id % 4 <> 3 AND l.doc_id % 12 <= 10
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id) x
GROUP BY enricher""")

# --- P24 P25 W10 -------------------------------------------------------------------------


@query("request_batches")
def _(c: Context):
    """Per-source consecutive batches of 10 and their payload text."""
    d = enrich.prune_fields(c.t.documents, ["doc_id", "source", "lang"])
    d = d.select("doc_id", "source", F.concat(F.col("doc_id").cast("string"), F.lit("|"), F.col("lang")).alias("item"))
    b = enrich.assign_batches(d, ["source"], ["doc_id"], 10)
    return enrich.batch_payloads(b, ["source"], "item")


oracle("request_batches", """
SELECT source, batch_no, CAST(count(*) AS BIGINT) AS n_items,
       string_agg('I' || CAST(item_no AS VARCHAR) || ': ' || CAST(doc_id AS VARCHAR) || '|' || lang, chr(10)
                  ORDER BY item_no) AS payload
FROM (SELECT doc_id, source, lang,
             CAST((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 10 AS BIGINT) AS batch_no,
             CAST((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) % 10 + 1 AS INTEGER) AS item_no
      FROM documents) x
GROUP BY source, batch_no""")

# --- P26 -----------------------------------------------------------------------------------


@query("profile_text")
def _(c: Context):
    """The five-line embedding profile of every dashboard player."""
    d = c.dashboard
    return d.select("player_id", enrich.profile_text(d).alias("profile"))


oracle("profile_text", """
SELECT player_id,
       coalesce(web_name, 'Unknown') || ' (' || coalesce(position, 'N/A') || ', ' || coalesce(team_name, 'N/A')
       || '). Price: £' || coalesce(CAST(price AS VARCHAR), 'N/A') || 'm. Form: '
       || coalesce(CAST(form AS VARCHAR), 'N/A') || '.' || chr(10)
       || 'Points: ' || coalesce(CAST(total_points AS VARCHAR), 'N/A') || '. Goals: '
       || coalesce(CAST(goals_scored AS VARCHAR), 'N/A') || ', Assists: '
       || coalesce(CAST(assists AS VARCHAR), 'N/A') || '.' || chr(10)
       || 'Summary: ' || coalesce(nullif(llm_summary, ''), 'No summary available') || chr(10)
       || 'Form trend: ' || coalesce(nullif(form_trend, ''), 'N/A') || '. Injury risk: '
       || coalesce(CAST(injury_risk AS VARCHAR), 'N/A') || '/10.' || chr(10)
       || 'Fixture difficulty (next 3): ' || coalesce(CAST(fdr_next_3 AS VARCHAR), 'N/A') || '/5.' AS profile
FROM v_dashboard""", "v_dashboard")

# --- X3 X4 ---------------------------------------------------------------------------------

EMBED_DIM = 16


def hashed_embedder(texts: list[str]) -> list[list[float]]:
    """Deterministic stand-in for the injected embedding model: hashed
    character-trigram counts over the WHOLE text, L2-normalised."""
    out = []
    for t in texts:
        cp = np.frombuffer((t or "").lower().encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        if len(cp) >= 3:
            h = (cp[:-2] * 961 + cp[1:-1] * 31 + cp[2:]) % EMBED_DIM
            v = np.bincount(h, minlength=EMBED_DIM).astype(np.float64)
        else:
            v = np.zeros(EMBED_DIM, dtype=np.float64)
        n = np.linalg.norm(v)
        out.append((v / n if n else v).astype(np.float32).tolist())
    return out


@query("embed_batch")
def _(c: Context):
    """Injected embedder over Arrow batches of whole documents; the
    length check nulls wrong-sized vectors."""
    e = enrich.embed(c.t.documents.select("doc_id", "text"), "text", hashed_embedder, EMBED_DIM)
    return e.select("doc_id", F.size("embedding").alias("dim"),
                    F.bround(F.sqrt(F.aggregate(F.col("embedding"), F.lit(0.0),
                                                lambda a, x: a + x.cast("double") * x.cast("double"))), 3)
                    .alias("norm"))


# The embedder's contract, checkable in SQL: every vector has EMBED_DIM
# components and unit length (zero for texts shorter than one trigram).
oracle("embed_batch", f"""
SELECT doc_id, CAST({EMBED_DIM} AS INTEGER) AS dim,
       CASE WHEN length(text) >= 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS norm
FROM documents""")


@query("article_counts")
def _(c: Context):
    """J5 per entity: how many articles mention each benchmark passage, 0
    when none (the long-form pairs stay the attachment; a count per entity
    replaces the product's per-entity list, which is unbounded)."""
    pairs = enrich.containment_join(c.t.benchmark, c.t.documents, "item_id", "text", "doc_id", "text")
    n = pairs.groupBy("item_id").agg(F.count(F.lit(1)).alias("articles"))
    return c.t.benchmark.select("item_id").join(n, "item_id", "left").select(
        "item_id", F.coalesce(F.col("articles"), F.lit(0)).cast("bigint").alias("articles"))


oracle("article_counts", """
SELECT b.item_id, CAST(count(d.doc_id) AS BIGINT) AS articles
FROM benchmark b LEFT JOIN documents d
  ON length(b.text) > 0 AND strpos(lower(d.text), lower(b.text)) > 0
GROUP BY b.item_id""")


# --- J5: news by short or full name --------------------------------------------------------------

view("v_entities", (), r"""
SELECT CASE WHEN item_id % 13 <> 0 THEN item_id END AS item_id, item_id AS no,
       CASE WHEN item_id % 3 = 0 THEN text WHEN item_id % 7 = 0 THEN ' ' END AS web_name,
       CASE WHEN item_id % 5 <> 0 THEN w[2] END AS first_name, CASE WHEN item_id % 10 <> 0 THEN w[3] END AS second_name
FROM (SELECT item_id, text, regexp_extract_all(text, '\p{L}+') AS w FROM benchmark)
UNION ALL SELECT NULL, -1, 'No Such Name', NULL, ''""")
view("v_news", (), """
SELECT CASE WHEN doc_id % 17 <> 0 THEN doc_id END AS doc_id, doc_id AS no, source || ' ' || doc_id AS title,
       text AS summary, source FROM documents
UNION ALL
SELECT CASE WHEN doc_id % 17 <> 0 THEN doc_id END, doc_id, source || ' ' || doc_id, text, source
FROM documents WHERE doc_id % 20 = 0""")


@query("entity_news")
def _(c: Context):
    """Articles by short OR full name over title + summary; entities and
    articles without an id and repeated articles are kept, an entity that no
    article mentions has an empty array."""
    k = F.col("item_id")
    w = F.regexp_extract_all("text", F.lit(r"\p{L}+"), 0)
    ent = c.t.benchmark.select(
        F.when(k % 13 != 0, k).alias("item_id"), k.alias("no"),
        F.when(k % 3 == 0, F.col("text")).when(k % 7 == 0, " ").alias("web_name"),
        F.when(k % 5 != 0, F.get(w, 1)).alias("first_name"), F.when(k % 10 != 0, F.get(w, 2)).alias("second_name"))
    ent = ent.unionByName(c.spark.createDataFrame(
        [(None, -1, "No Such Name", None, "")], ent.schema))
    d = c.t.documents
    news = d.unionByName(d.where(F.col("doc_id") % 20 == 0)).select(
        F.when(F.col("doc_id") % 17 != 0, F.col("doc_id")).alias("doc_id"),
        F.concat_ws(" ", "source", F.col("doc_id").cast("string")).alias("title"),
        F.col("text").alias("summary"), "source")
    numbered, matches = enrich.entity_articles(ent, news, "web_name", "first_name", "second_name")
    e = enrich.attach_articles(numbered, matches, ["title"], ["doc_id", "title", "source"])
    titles = F.transform("news_articles", lambda x: x["title"])
    return e.select("item_id", "no", F.size("news_articles").alias("articles"),
                    F.size(F.filter("news_articles", lambda x: x["doc_id"].isNull())).alias("without_id"),
                    F.md5(F.array_join(titles, "|")).alias("titles_md5"))


oracle("entity_news", """
SELECT e.item_id, e.no, CAST(count(n.no) AS INTEGER) AS articles,
       CAST(count(n.no) FILTER (WHERE n.doc_id IS NULL) AS INTEGER) AS without_id,
       md5(coalesce(string_agg(n.title, '|' ORDER BY n.title), '')) AS titles_md5
FROM v_entities e LEFT JOIN v_news n
  ON (trim(coalesce(e.web_name, '')) <> ''
      AND strpos(lower(n.title || ' ' || coalesce(n.summary, '')), lower(e.web_name)) > 0)
  OR (trim(coalesce(e.first_name, '') || coalesce(e.second_name, '')) <> ''
      AND strpos(lower(n.title || ' ' || coalesce(n.summary, '')),
                 lower(coalesce(e.first_name, '') || ' ' || coalesce(e.second_name, ''))) > 0)
GROUP BY e.item_id, e.no""", "v_entities", "v_news")
