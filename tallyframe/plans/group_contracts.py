"""Catalogue entries: nested contracts, the judge, run scores and published
dates (Q6 Q7 Q11 X4 A15 F-str9 F-date4 S6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions.dates import published_at
from tallyframe.operators import contracts, curate, enrich, evals
from tallyframe.plans.catalog import query
from tallyframe.plans.context import Context
from tallyframe.plans.group_enrich import STANDIN_KEYWORDS
from tallyframe.plans.oracle import oracle
from tallyframe.plans.oracle_views import view
from tallyframe.sources import standins


def _pick(key, options):
    """The option at ``key`` modulo their number (null: that key is left out)."""
    return F.element_at(F.array(*[F.lit(o) for o in options]),
                        (F.pmod(key, F.lit(len(options))) + 1).cast("int"))


def _pick_sql(key: str, options) -> str:
    listed = ", ".join("NULL" if o is None else "'" + o.replace("'", "''") + "'" for o in options)
    return f"([{listed}])[({key}) % {len(options)} + 1]"


# --- Q7: answers of two enrichers, some of which break their contract -------------------------

# Fixed values of the stand-in: JSON fragments by document number.
SENTIMENTS = ['"positive"', '"negative"', '"neutral"', '"mixed"', '"unsure"']
SCORES = ["-1.2", "-0.8", "-0.4", "0", "0.4", "0.8", "1.2", '"0.5"']
THEMES = ['["form","price"]', "[]", "null", '["form",3]', '"form"', None]
DIFFICULTIES = ["0", "1", "2", "3", "4", "5", "6", "2.5", "4.0"]
WEEKS = ["[1,2]", "[1,2.0]", '[1,"2"]', "[null,3]", None]


def _answers(c: Context):
    k = F.col("doc_id")
    sentiment = F.concat(
        F.lit('{"sentiment":'), _pick(k, SENTIMENTS), F.lit(',"score":'), _pick(k, SCORES),
        F.coalesce(F.concat(F.lit(',"key_themes":'), _pick(k, THEMES)), F.lit("")),
        F.when(k % 11 == 0, ',"note":{"x":1}').otherwise(""), F.lit("}"))
    outlook = F.concat(
        F.lit('{"difficulty_score":'), _pick(k, DIFFICULTIES),
        F.when(k % 10 == 0, "").when(k % 7 == 0, ',"recommendation":""').otherwise(',"recommendation":"buy"'),
        F.coalesce(F.concat(F.lit(',"best_gameweeks":'), _pick(k, WEEKS)), F.lit("")), F.lit("}"))
    d = c.t.documents.select("doc_id")
    return (d.select("doc_id", F.when(k % 13 == 0, "no json").otherwise(sentiment).alias("answer")),
            d.select("doc_id", outlook.alias("answer")))


@query("output_contracts")
def _(c: Context):
    """Q7: sentiment and fixture-outlook answers against their nested
    contracts: broken rules by path."""
    sentiment, outlook = _answers(c)
    parts = [contracts.checked_json(df, "answer", rule).select(
        "doc_id", F.lit(name).alias("enricher"), "is_valid", F.array_join("broken", "|").alias("broken"))
        for df, rule, name in ((sentiment, contracts.SENTIMENT_OUTPUT, "sentiment"),
                               (outlook, contracts.OUTLOOK_OUTPUT, "fixture_outlook"))]
    return parts[0].unionByName(parts[1])


view("v_answers", (), f"""
SELECT doc_id, 'sentiment' AS enricher, CASE WHEN doc_id % 13 = 0 THEN 'no json' ELSE
  '{{"sentiment":' || {_pick_sql('doc_id', SENTIMENTS)} || ',"score":' || {_pick_sql('doc_id', SCORES)}
  || coalesce(',"key_themes":' || {_pick_sql('doc_id', THEMES)}, '')
  || CASE WHEN doc_id % 11 = 0 THEN ',"note":{{"x":1}}' ELSE '' END || '}}' END AS j
FROM documents
UNION ALL
SELECT doc_id, 'fixture_outlook',
  '{{"difficulty_score":' || {_pick_sql('doc_id', DIFFICULTIES)}
  || CASE WHEN doc_id % 10 = 0 THEN '' WHEN doc_id % 7 = 0 THEN ',"recommendation":""'
          ELSE ',"recommendation":"buy"' END
  || coalesce(',"best_gameweeks":' || {_pick_sql('doc_id', WEEKS)}, '') || '}}'
FROM documents""")

_NUMERIC = "('DOUBLE', 'BIGINT', 'UBIGINT')"
oracle("output_contracts", f"""
SELECT * FROM (WITH s AS (
  SELECT *, json_type(j, '$.score') AS st, json_type(j, '$.key_themes') AS tt,
         json_extract(j, '$.key_themes[*]') AS ti
  FROM v_answers WHERE enricher = 'sentiment' AND json_valid(j)),
o AS (
  SELECT *, TRY_CAST(json_extract_string(j, '$.difficulty_score') AS DOUBLE) AS dv,
         json_extract(j, '$.best_gameweeks[*]') AS wi
  FROM v_answers WHERE enricher = 'fixture_outlook'),
b AS (
  SELECT doc_id, enricher, ['$:document'] AS x FROM v_answers WHERE NOT json_valid(j)
  UNION ALL
  SELECT doc_id, enricher, [
    CASE WHEN len(list_filter(json_keys(j), lambda k: k NOT IN ('sentiment', 'score', 'key_themes'))) > 0
         THEN '$:unknown_key' END,
    CASE WHEN json_extract_string(j, '$.sentiment') NOT IN ('positive', 'negative', 'neutral', 'mixed')
         THEN '$.sentiment:allowed' END,
    CASE WHEN st NOT IN {_NUMERIC} THEN '$.score:type' END,
    CASE WHEN st IN {_NUMERIC} AND CAST(json_extract(j, '$.score') AS DOUBLE) < -1 THEN '$.score:minimum' END,
    CASE WHEN st IN {_NUMERIC} AND CAST(json_extract(j, '$.score') AS DOUBLE) > 1 THEN '$.score:maximum' END,
    CASE WHEN tt = 'NULL' THEN '$.key_themes:null' END,
    CASE WHEN tt NOT IN ('NULL', 'ARRAY') THEN '$.key_themes:type' END,
    CASE WHEN len(list_filter(ti, lambda e: json_type(e) <> 'VARCHAR')) > 0 THEN '$.key_themes[]:type' END]
  FROM s
  UNION ALL
  SELECT doc_id, enricher, [
    CASE WHEN dv <> floor(dv) THEN '$.difficulty_score:type' END,
    CASE WHEN dv < 1 THEN '$.difficulty_score:minimum' END,
    CASE WHEN dv > 5 THEN '$.difficulty_score:maximum' END,
    CASE WHEN json_type(j, '$.recommendation') IS NULL THEN '$.recommendation:missing' END,
    CASE WHEN json_extract_string(j, '$.recommendation') = '' THEN '$.recommendation:min_length' END,
    CASE WHEN len(list_filter(wi, lambda e: json_type(e) = 'NULL')) > 0 THEN '$.best_gameweeks[]:null' END,
    CASE WHEN len(list_filter(wi, lambda e: json_type(e) = 'VARCHAR')) > 0 THEN '$.best_gameweeks[]:type' END]
  FROM o)
SELECT doc_id, enricher, len(list_filter(x, lambda r: r IS NOT NULL)) = 0 AS is_valid,
       array_to_string(list_filter(x, lambda r: r IS NOT NULL), '|') AS broken
FROM b)""", "v_answers")


# --- Q6: curated rows with faults ---------------------------------------------------------------

@query("contract_counts")
def _(c: Context):
    """Q6: ticker, pick and team rows, with faults put in, against their
    contracts: values and rows that break a rule, by path."""
    ticker = c.ticker.select(
        "*", F.when(F.col("fixture_id") % 31 == 0, 6).when(F.col("fixture_id") % 29 == 0, 0).otherwise(F.col("fdr"))
        .alias("_fdr")).drop("fdr").withColumnRenamed("_fdr", "fdr")
    ticker = (ticker.withColumn("opponent", F.when(F.col("fixture_id") % 37 != 0, F.col("opponent")))
              .withColumn("kickoff_time", F.col("kickoff_time").cast("string")))
    picks = c.picks_shared
    p = F.col("player_id")
    picks = (picks.withColumn("recommendation", F.when(p % 19 == 0, "maybe").otherwise(F.col("recommendation")))
             .withColumn("recommendation_reasons", F.when(p % 23 == 0, F.concat(
                 F.col("recommendation_reasons"), F.array(F.lit(None).cast("string"), F.lit(None).cast("string"))))
                 .when(p % 17 == 0, F.lit(None)).otherwise(F.col("recommendation_reasons")))
             .withColumn("price", F.when(p % 41 == 0, F.lit(None)).otherwise(F.col("price"))))
    strength = curate.team_strength(c.dashboard_shared, c.fdr_shared, c.season, c.gw)
    strength = (strength.withColumn("squad_value", F.when(F.col("team_id") % 5 != 0, F.col("squad_value")))
                .withColumn("top_scorer_id", F.col("top_scorer_id") + F.when(F.col("team_id") % 7 == 0, 0.5).otherwise(0.0)))
    out = contracts.contract_counts(ticker, contracts.TICKER_ROW, "fixture_ticker")
    for df, rule, name in ((picks, contracts.PICK_ROW, "transfer_picks"),
                           (strength, contracts.STRENGTH_ROW, "team_strength")):
        out = out.unionByName(contracts.contract_counts(df, rule, name))
    return out


# Every rule of the contracts as a condition on the faulty rows.
_TICKER_RULES = [(f"$.{f}", "null", f"{f} IS NULL") for f in (
    "team_id", "team_name", "team_short", "gameweek", "opponent", "opponent_short", "is_home", "fdr", "season")] + [
    ("$.fdr", "minimum", "fdr < 1"), ("$.fdr", "maximum", "fdr > 5")]
_PICK_RULES = [(f"$.{f}", "null", f"{f} IS NULL") for f in (
    "player_id", "web_name", "team_name", "team_short", "position", "price", "composite_score", "composite_rank",
    "recommendation", "recommendation_reasons", "form", "net_transfers", "season", "gameweek")] + [
    ("$.recommendation", "allowed", "recommendation NOT IN ('buy', 'sell', 'hold', 'watch')")]
_STRENGTH_RULES = [(f"$.{f}", "null", f"{f} IS NULL") for f in (
    "team_id", "team_name", "team_short", "avg_composite_score", "total_points", "avg_form", "squad_value",
    "top_scorer_id", "top_scorer_name", "top_scorer_points", "player_count", "enriched_player_count", "season",
    "gameweek")] + [("$.top_scorer_id", "type", "top_scorer_id <> floor(top_scorer_id)")]


def _rules_sql(name: str, src: str, rules) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{name}' AS document, '{path}' AS path, '{rule}' AS rule, CAST(count(*) AS BIGINT) AS values, "
        f"CAST(count(*) AS BIGINT) AS documents FROM {src} WHERE {bad}" for path, rule, bad in rules)


view("v_team_strength_ids", ("v_dashboard", "v_fdr"), """
SELECT d.team_id, d.team_name, d.team_short, avg(d.composite_score) AS avg_composite_score,
  sum(d.total_points) AS total_points, avg(d.form) AS avg_form, sum(d.price) AS squad_value,
  arg_max(d.player_id, row(d.total_points, -d.src_pos)) AS top_scorer_id,
  arg_max(d.web_name, row(d.total_points, -d.src_pos)) AS top_scorer_name,
  arg_max(d.total_points, row(d.total_points, -d.src_pos)) AS top_scorer_points,
  count(*) AS player_count, count(d.llm_summary) AS enriched_player_count, any_value(season) AS season,
  any_value(gameweek) AS gameweek
FROM v_dashboard d GROUP BY d.team_id, d.team_name, d.team_short""")

oracle("contract_counts", f"""
SELECT * FROM (WITH t AS (
  SELECT * REPLACE (CASE WHEN fixture_id % 31 = 0 THEN 6 WHEN fixture_id % 29 = 0 THEN 0 ELSE fdr END AS fdr,
                    CASE WHEN fixture_id % 37 <> 0 THEN opponent END AS opponent) FROM v_ticker),
p AS (
  SELECT * REPLACE (CASE WHEN player_id % 19 = 0 THEN 'maybe' ELSE recommendation END AS recommendation,
                    CASE WHEN player_id % 41 <> 0 THEN price END AS price,
                    CASE WHEN player_id % 23 = 0 THEN list_concat(recommendation_reasons, [NULL, NULL])
                         WHEN player_id % 17 = 0 THEN NULL ELSE recommendation_reasons END
                      AS recommendation_reasons) FROM v_picks),
s AS (
  SELECT * REPLACE (CASE WHEN team_id % 5 <> 0 THEN squad_value END AS squad_value,
                    top_scorer_id + CASE WHEN team_id % 7 = 0 THEN 0.5 ELSE 0 END AS top_scorer_id)
  FROM v_team_strength_ids)
SELECT * FROM (
{_rules_sql('fixture_ticker', 't', _TICKER_RULES)}
UNION ALL
{_rules_sql('transfer_picks', 'p', _PICK_RULES)}
UNION ALL
SELECT 'transfer_picks', '$.recommendation_reasons[]', 'null',
       CAST(sum(len(recommendation_reasons) - len(list_filter(recommendation_reasons, lambda x: x IS NOT NULL))) AS BIGINT),
       CAST(count(*) AS BIGINT)
FROM p WHERE len(recommendation_reasons) > len(list_filter(recommendation_reasons, lambda x: x IS NOT NULL))
UNION ALL
{_rules_sql('team_strength', 's', _STRENGTH_RULES)}) x WHERE values > 0)""", "v_ticker", "v_picks", "v_team_strength_ids")


# --- X4: the judge --------------------------------------------------------------------------------

def standin_judge(batch: list[dict]) -> list[dict]:
    """A deterministic stand-in for the judge call: scores by bullet and an
    overall score; it fails, forgets a bullet, scores out of range, drifts or
    adds a key for some cases."""
    out = []
    for run in batch:
        k = run["case_id"]
        if k % 23 == 0:
            raise ValueError(f"no verdict for case {k}")
        points = [(k + i) % 6 for i in range(run["rubric_size"] - (k % 7 == 0))]
        if points and k % 9 == 0:
            points[0] = 9
        verdict = {"scores": [{"bullet": i, "score": x} for i, x in enumerate(points, 1)],
                   "overall": (sum(points) / len(points) if points else 0.0) + (k % 5 == 0),
                   "reasoning": f"{len(points)} bullets"}
        if k % 19 == 0:
            verdict["scores"] = [{**s, "note": "x"} for s in verdict["scores"]]
        out.append(verdict)
    return out


@query("judge_runs")
def _(c: Context):
    """An injected judge over all runs; its verdicts checked by
    contract, count of scores and drift of the overall score."""
    runs = c.t.conversations.groupBy(F.col("conv_id").alias("case_id")).agg(
        F.count("*").cast("int").alias("rubric_size"))
    return evals.judge_runs(runs, standin_judge, ["case_id", "rubric_size"])


oracle("judge_runs", """
WITH r AS (SELECT conv_id AS k, count(*) AS n FROM conversations GROUP BY conv_id),
s AS (
  SELECT k, n, [CASE WHEN i = 0 AND k % 9 = 0 THEN 9 ELSE (k + i) % 6 END
                FOR i IN range(n - CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END)] AS points FROM r),
o AS (
  SELECT *, coalesce(list_sum(points) / len(points)::DOUBLE, 0)::DOUBLE AS mean,
         coalesce(list_sum(points) / len(points)::DOUBLE, 0)::DOUBLE + CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END AS overall,
         k % 23 = 0 AS failed FROM s),
b AS (
  SELECT *, CASE WHEN failed THEN '' ELSE array_to_string(list_filter([
    CASE WHEN k % 19 = 0 AND len(points) > 0 THEN '$.scores[]:unknown_key' END,
    CASE WHEN list_max(points) > 5 THEN '$.scores[].score:maximum' END,
    CASE WHEN overall > 5 THEN '$.overall:maximum' END], lambda x: x IS NOT NULL), '|') END AS broken
  FROM o)
SELECT k AS case_id, CASE WHEN failed THEN 'ValueError: no verdict for case ' || k END AS error,
       NOT failed AND broken = '' AS is_valid, broken,
       CASE WHEN NOT failed AND broken = '' THEN len(points) = n END AS count_ok,
       CASE WHEN NOT failed AND broken = '' AND len(points) > 0 THEN abs(overall - mean) > 0.5 END AS drift_flag
FROM b""")


# --- A15 F-str9: run scores ---------------------------------------------------------------------

@query("run_scores")
def _(c: Context):
    """A15 F-str9: calls keyed by name and sorted arguments, repeated calls,
    tool success, output_valid and iterations of every run."""
    turn, size = F.col("turn"), F.length("text")
    b = F.when(size % 10 == 0, F.concat(F.lit('"'), F.repeat(F.lit("long name "), 9), F.lit('"'))).otherwise(
        F.floor(turn / 2 % 3).cast("string"))
    nested = F.concat(F.lit('{"z":1,"y":['), (size % 2).cast("string"), F.lit(',true,null]}'))
    back = F.concat(F.lit('{"y":['), (size % 2).cast("string"), F.lit(',true,null],"z":1}'))
    args = (F.when(turn % 7 == 6, F.lit(None)).when(turn % 7 == 5, "{}")
            .when(turn % 2 == 0, F.concat(F.lit('{"b":'), b, F.lit(',"a":'), nested, F.lit("}")))
            .otherwise(F.concat(F.lit('{"a":'), back, F.lit(',"b":'), b, F.lit("}"))))
    calls = c.t.conversations.select(
        F.col("conv_id").alias("case_id"), turn.alias("seq"), F.col("role").alias("name"), args.alias("args"),
        F.when(size < 60, "short answer").alias("error"))
    runs = c.t.conversations.groupBy(F.col("conv_id").alias("case_id")).agg(
        (F.max_by("role", "turn") == "assistant").alias("answered"),
        F.when(F.col("conv_id") % 17 == 0, "stopped").alias("error"),
        F.count_if(F.col("role") == "assistant").alias("iterations"))
    return evals.run_scores(calls, runs)


oracle("run_scores", """
WITH c AS (
  SELECT conv_id, turn, role, length(text) < 60 AS failed,
         CASE WHEN turn % 7 >= 5 THEN '' ELSE 'a={y=[' || (length(text) % 2) || ',True,None],z=1},b='
              || CASE WHEN length(text) % 10 = 0 THEN repeat('long name ', 9)
                      ELSE CAST((turn // 2) % 3 AS VARCHAR) END END AS args
  FROM conversations),
keyed AS (
  SELECT *, CASE WHEN args = '' THEN role
                 WHEN length(args) > 80 THEN role || '#' || (('0x' || substr(md5(args), 1, 8))::BIGINT % 10000)
                 ELSE role || '(' || args || ')' END AS key FROM c),
last AS (SELECT conv_id, key, count(*) AS n, arg_max(failed, turn) AS failed FROM keyed GROUP BY conv_id, key),
fold AS (SELECT conv_id, sum(n) AS calls, count(*) AS results, count_if(failed) AS failed FROM last GROUP BY conv_id),
runs AS (SELECT conv_id, arg_max(role, turn) = 'assistant' AS answered, count_if(role = 'assistant') AS iterations
         FROM conversations GROUP BY conv_id)
SELECT conv_id AS case_id, CAST(calls AS BIGINT) AS calls, CAST(results AS BIGINT) AS results,
       CAST(calls - results AS BIGINT) AS repeated,
       CASE WHEN answered AND conv_id % 17 <> 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS output_valid,
       iterations::DOUBLE AS iterations_used, round_even(1.0::DOUBLE - failed / results, 4) AS tool_success_rate
FROM runs JOIN fold USING (conv_id)""")


# --- F-date4 S6: published dates -------------------------------------------------------------------

# Fixed values of the stand-in: layout of the text and its offset in hours.
LAYOUTS = [("EEE, dd MMM yyyy HH:mm:ss 'GMT'", "mail", 0), ("EEE, d MMM yyyy HH:mm:ss '-0500'", "mail", -5),
           ("dd MMM yy HH:mm:ss 'EST'", "mail", -5), ("yyyy-MM-dd'T'HH:mm:ss'Z'", "iso", 0),
           ("yyyy-MM-dd'T'HH:mm:ss'+05:30'", "iso", 5.5), ("yyyy-MM-dd HH:mm:ss", "iso", 0),
           ("yyyy-MM-dd", "date", 0), ("'on' EEEE", None, 0)]
PRODUCT_AND_STANDIN_KEYWORDS = [*enrich.PL_KEYWORDS, *STANDIN_KEYWORDS]


def _dated_articles(c: Context):
    k = F.col("doc_id")
    at = (F.to_timestamp_ntz(F.lit(f"{standins.ARTICLE_BASE_DATE} 00:30:00"))
          + F.make_dt_interval((k % 7).cast("int"), (k % 24).cast("int")))
    a = standins.articles(c.t).withColumn("_at", at)
    text = F.coalesce(*[F.when(F.pmod(k, F.lit(len(LAYOUTS))) == i, F.date_format("_at", form))
                        for i, (form, _, _) in enumerate(LAYOUTS)])
    return a.withColumn("published_text", text).withColumn("p", published_at(F.col("published_text")))


@query("published_dates")
def _(c: Context):
    """F-date4: dates of seven feed layouts, in UTC; unreadable ones null."""
    return _dated_articles(c).select("doc_id", F.col("p.layout").alias("layout"), F.col("p.date").alias("published"))


_LAYOUT_CASE = "CASE doc_id % 8 " + " ".join(
    f"WHEN {i} THEN {repr(v) if v else 'NULL'}" for i, (_, v, _) in enumerate(LAYOUTS)) + " END"
_MINUTES = "CASE doc_id % 8 " + " ".join(
    f"WHEN {i} THEN {int(-h * 60)}" for i, (_, _, h) in enumerate(LAYOUTS)) + " END"
view("v_published", (), f"""
SELECT doc_id, {_LAYOUT_CASE} AS layout, CASE WHEN doc_id % 8 = 7 THEN NULL ELSE
  CAST(TIMESTAMP '{standins.ARTICLE_BASE_DATE} 00:30:00' + to_hours(CAST(24 * (doc_id % 7) + doc_id % 24 AS INTEGER))
       + to_minutes({_MINUTES}) AS DATE) END AS published
FROM documents""")
oracle("published_dates", "SELECT * FROM v_published", "v_published")


@query("news_relevance")
def _(c: Context):
    """S6 F-date4: articles whose published text falls on their own date and
    that hold one of the product's 27 keywords or a stand-in word, per date,
    with the articles of unreadable dates."""
    a = _dated_articles(c)
    text = F.lower(F.concat_ws(" ", "title", "summary"))
    hit = text.rlike(enrich.keyword_pattern(PRODUCT_AND_STANDIN_KEYWORDS))
    return a.groupBy("date").agg(
        F.count("*").alias("articles"), F.count_if(F.col("p.date").isNull()).alias("unreadable"),
        F.count_if(F.coalesce(F.col("p.date") == F.col("date"), F.lit(False)) & hit).alias("relevant"))


_ALL_KW = " OR ".join(f"strpos(lower(title || ' ' || summary), '{k}') > 0" for k in PRODUCT_AND_STANDIN_KEYWORDS)
oracle("news_relevance", f"""
SELECT a.date, CAST(count(*) AS BIGINT) AS articles, CAST(count_if(p.published IS NULL) AS BIGINT) AS unreadable,
       CAST(count_if(coalesce(p.published = a.date, false) AND ({_ALL_KW})) AS BIGINT) AS relevant
FROM v_articles a JOIN v_published p ON a.doc_id = p.doc_id GROUP BY a.date""", "v_articles", "v_published")
