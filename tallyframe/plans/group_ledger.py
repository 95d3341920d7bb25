"""Catalogue entries: usage ledger and admission (A9-A11 W8 W9 T5 batch) and
evaluation roll-ups (A12-A15 Q9-Q11 U3 U6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.operators import evals, ledger
from tallyframe.plans.catalog import query
from tallyframe.plans.context import Context
from tallyframe.plans.oracle import oracle
from tallyframe.plans.oracle_views import view

# --- stand-ins: usage and requests from events ------------------------------------------------

# Fixed values of the stand-in binding: event type -> model, user -> graph node.
EVENT_MODEL = {"view": "claude-haiku-4-5-20251001", "click": "claude-sonnet-4-6",
               "purchase": "claude-haiku-4-5", "signup": "claude-sonnet-4-6"}
NODES = ["planner", "tool_executor", "reflector", "recommender"]
DAILY_LIMIT_USD = "10.0"
# W9 windows scaled to the sparse event stream: 10 h / 25 days instead of 60 s / 3600 s.
SHORT_S, SHORT_N, LONG_S, LONG_N = 36_000, 5, 2_160_000, 20


def _as_double(df, cols):
    """Exact DECIMAL inside; DOUBLE at the result boundary (a DECIMAL's text
    form, e.g. 0E-6 vs 0.000000, differs between engines)."""
    return df.select(*[F.col(x).cast("double").alias(x) if x in cols else F.col(x) for x in df.columns])


def usage(c: Context):
    e = c.t.events
    model = F.lit("unknown-model")
    for k, v in reversed(list(EVENT_MODEL.items())):
        model = F.when(F.col("event_type") == k, F.lit(v)).otherwise(model)
    node = F.element_at(F.array(*[F.lit(n) for n in NODES]), (F.col("user_id") % 4 + 1).cast("int"))
    secs = (F.unix_date(F.to_date("ts")).cast("bigint") * 86400 + F.hour("ts") * 3600
            + F.minute("ts") * 60 + F.second("ts"))
    return e.select("event_id", "user_id", "ts", model.alias("model"), node.alias("node"),
                    F.round(F.col("value") * 100).cast("bigint").alias("input_tokens"),
                    (F.get_json_object("props", "$.k").cast("bigint") * 10).alias("output_tokens"),
                    F.date_format("ts", "yyyy-MM-dd").alias("day"), secs.cast("bigint").alias("secs"))


_MODEL_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_MODEL.items()) \
    + " ELSE 'unknown-model' END"
view("v_usage", (), f"""
SELECT event_id, user_id, ts, {_MODEL_SQL} AS model,
       CASE user_id % 4 WHEN 0 THEN 'planner' WHEN 1 THEN 'tool_executor' WHEN 2 THEN 'reflector'
            ELSE 'recommender' END AS node,
       CAST(round(value * 100) AS BIGINT) AS input_tokens,
       CAST(json_extract_string(props, '$.k') AS BIGINT) * 10 AS output_tokens,
       strftime(ts, '%Y-%m-%d') AS day,
       CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS BIGINT) * 86400
         + hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS secs
FROM events""")


def _rates_sql(rates: dict) -> str:
    rows = ", ".join(f"('{m}', CAST('{i}' AS DECIMAL(10,4)), CAST('{o}' AS DECIMAL(10,4)))"
                     for m, (i, o) in rates.items())
    return f"(SELECT * FROM (VALUES {rows}) r(model, input_per_mtok, output_per_mtok))"


def _cost_sql(fallback=None):
    fi = f"CAST('{fallback[0]}' AS DECIMAL(10,4))" if fallback else "CAST(0 AS DECIMAL(10,4))"
    fo = f"CAST('{fallback[1]}' AS DECIMAL(10,4))" if fallback else "CAST(0 AS DECIMAL(10,4))"
    return (f"CAST(round_even((CAST(u.input_tokens AS DECIMAL(12,0)) * coalesce(r.input_per_mtok, {fi}) "
            f"+ CAST(u.output_tokens AS DECIMAL(12,0)) * coalesce(r.output_per_mtok, {fo})) "
            f"* CAST('0.000001' AS DECIMAL(7,6)), 6) AS DECIMAL(18,6))")


view("v_priced_enrich", ("v_usage",), f"""
SELECT u.*, {_cost_sql()} AS cost_usd FROM v_usage u LEFT JOIN {_rates_sql(ledger.ENRICH_RATES)} r
  ON u.model = r.model""")
view("v_priced_agent", ("v_usage",), f"""
SELECT u.*, {_cost_sql(ledger.AGENT_FALLBACK)} AS cost_usd FROM v_usage u
LEFT JOIN {_rates_sql(ledger.AGENT_RATES)} r ON u.model = r.model""")


@query("cost_report")
def _(c: Context):
    """Tokens and cost per (node, model) plus the grand total."""
    r = ledger.cost_report(usage(c), ledger.rates_frame(c.spark, ledger.ENRICH_RATES))
    return _as_double(r, ["cost_usd"])


oracle("cost_report", """
SELECT coalesce(node, 'all') AS node, coalesce(model, 'all') AS model,
       CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
       CAST(CAST(sum(cost_usd) AS DECIMAL(18,6)) AS DOUBLE) AS cost_usd
FROM v_priced_enrich GROUP BY GROUPING SETS ((node, model), ())""", "v_priced_enrich")


def _priced_agent(c: Context):
    return ledger.with_cost(usage(c), ledger.rates_frame(c.spark, ledger.AGENT_RATES), ledger.AGENT_FALLBACK)


@query("budget_ledger")
def _(c: Context):
    """Daily spend with fallback pricing, remaining budget, exceeded flag."""
    return _as_double(ledger.budget_ledger(_priced_agent(c), "day", DAILY_LIMIT_USD),
                      ["spend_usd", "limit_usd", "remaining_usd"])


oracle("budget_ledger", f"""
SELECT day, requests, tokens, CAST(spend_usd AS DOUBLE) AS spend_usd, CAST(limit_usd AS DOUBLE) AS limit_usd,
       CAST(remaining_usd AS DOUBLE) AS remaining_usd, exceeded FROM (
SELECT day, CAST(count(*) AS BIGINT) AS requests, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS tokens,
       CAST(sum(cost_usd) AS DECIMAL(18,6)) AS spend_usd, CAST('{DAILY_LIMIT_USD}' AS DECIMAL(18,6)) AS limit_usd,
       CAST(greatest(CAST('{DAILY_LIMIT_USD}' AS DECIMAL(18,6)) - CAST(sum(cost_usd) AS DECIMAL(18,6)),
                     CAST(0 AS DECIMAL(18,6))) AS DECIMAL(18,6)) AS remaining_usd,
       CAST(sum(cost_usd) AS DECIMAL(18,6)) >= CAST('{DAILY_LIMIT_USD}' AS DECIMAL(18,6)) AS exceeded
FROM v_priced_agent GROUP BY day) x""", "v_priced_agent")


@query("budget_admission")
def _(c: Context):
    """Admitted iff the day's spend before the request is under the limit."""
    a = ledger.budget_admission(_priced_agent(c), "day", ["ts", "event_id"], DAILY_LIMIT_USD)
    return _as_double(a.select("event_id", "day", "cost_usd", "spend_before", "allowed", "crossed"),
                      ["cost_usd", "spend_before"])


oracle("budget_admission", f"""
SELECT event_id, day, CAST(cost_usd AS DOUBLE) AS cost_usd, CAST(spend_before AS DOUBLE) AS spend_before,
       spend_before < CAST('{DAILY_LIMIT_USD}' AS DECIMAL(18,6)) AS allowed,
       spend_before < CAST('{DAILY_LIMIT_USD}' AS DECIMAL(18,6))
         AND spend_before + cost_usd >= CAST('{DAILY_LIMIT_USD}' AS DECIMAL(18,6)) AS crossed
FROM (SELECT event_id, day, cost_usd,
             CAST(coalesce(sum(cost_usd) OVER (PARTITION BY day ORDER BY ts, event_id
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DECIMAL(18,6)) AS spend_before
      FROM v_priced_agent) x""", "v_priced_agent")


def requests(c: Context):
    u = usage(c)
    return u.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("request_id"),
                    F.col("secs").alias("t"))


@query("rate_admission")
def _(c: Context):
    """Sliding-window admission per session; rejected attempts are not
    recorded (rows-only: a recursion, tested against a brute-force twin)."""
    return ledger.rate_admission(requests(c), SHORT_S, SHORT_N, LONG_S, LONG_N)


@query("attempt_rate")
def _(c: Context):
    """T5 batch twin: attempts per session in the trailing 10 hours."""
    return ledger.attempt_rate(requests(c), SHORT_S)


oracle("attempt_rate", f"""
SELECT user_id AS session_id, event_id AS request_id,
       CAST(count(*) OVER (PARTITION BY user_id ORDER BY secs RANGE BETWEEN {SHORT_S} PRECEDING AND CURRENT ROW)
            AS BIGINT) AS attempts
FROM v_usage""", "v_usage")

# --- evaluation stand-ins from conversations ------------------------------------------------------

DIFFICULTY = ["easy", "medium", "hard"]


def cases_runs(c: Context):
    cv = c.t.conversations
    k = F.col("conv_id")
    t0 = cv.where(F.col("turn") == 0).select("conv_id", F.regexp_extract("text", r"(\p{L}{5,})", 1).alias("_w"))
    g = cv.groupBy("conv_id").agg(
        F.array_sort(F.collect_set("role")).alias("tool_calls_made"),
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("_t"),
        F.count(F.lit(1)).alias("_n"))
    later = F.filter("_t", lambda x: x["turn"] >= 1)
    analysis = F.array_join(F.transform(later, lambda x: x["text"]), " ")
    runs = g.select(
        F.col("conv_id").alias("case_id"), "tool_calls_made", analysis.alias("analysis"),
        (F.col("_n") > 4).alias("has_comparison"),
        F.transform(F.filter("_t", lambda x: x["role"] == "assistant"), lambda x: x["text"]).alias("caveats"),
        F.transform(later, lambda x: (F.length(x["text"]) % 5 + 1).cast("int")).alias("judge_scores"),
        F.when(k % 9 == 0, F.lit(None)).otherwise((k % 41) / F.lit(10.0) + 1).alias("judge_overall"),
        (F.size(later) + F.when(k % 6 == 0, 1).otherwise(0)).alias("rubric_size"))
    runs = runs.select("*", F.regexp_extract_all("analysis", F.lit(evals.PROPER_NAME), 1).alias("player_names"))
    cases = g.select("conv_id").join(t0, "conv_id", "left").select(
        F.col("conv_id").alias("case_id"),
        F.concat(F.lit("cat"), (k % 11).cast("string")).alias("category"),
        F.element_at(F.array(*[F.lit(d) for d in DIFFICULTY]), (k % 3 + 1).cast("int")).alias("difficulty"),
        F.array(F.lit("assistant")).alias("expected_tools"),
        F.when(k % 4 == 0, F.array(F.lit("system"))).otherwise(F.array().cast("array<string>")).alias("forbidden_tools"),
        F.when(F.coalesce(F.col("_w"), F.lit("")) == "", F.array().cast("array<string>"))
         .otherwise(F.array("_w")).alias("must_mention_players"),
        (k % 2 == 0).alias("match_word_boundary"), (k % 5 == 0).alias("must_set_comparison"),
        (k % 7 == 0).alias("must_have_empty_players_list"), (k % 3).cast("int").alias("min_caveats"))
    return cases, runs


view("v_runs", (), rf"""
SELECT conv_id AS case_id, list_sort(list_distinct(list(role))) AS tool_calls_made,
       coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (WHERE turn >= 1), '') AS analysis,
       count(*) > 4 AS has_comparison,
       CAST(count(*) FILTER (WHERE role = 'assistant') AS INTEGER) AS n_caveats,
       coalesce(list(CAST(length(text) % 5 + 1 AS INTEGER) ORDER BY turn) FILTER (WHERE turn >= 1),
                []::INTEGER[]) AS judge_scores,
       CASE WHEN conv_id % 9 = 0 THEN NULL ELSE (conv_id % 41) / 10.0::DOUBLE + 1 END AS judge_overall,
       CAST(count(*) FILTER (WHERE turn >= 1) + CASE WHEN conv_id % 6 = 0 THEN 1 ELSE 0 END AS INTEGER) AS rubric_size
FROM conversations GROUP BY conv_id""")
view("v_cases", (), r"""
SELECT c.conv_id AS case_id, 'cat' || CAST(c.conv_id % 11 AS VARCHAR) AS category,
       CASE c.conv_id % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END AS difficulty,
       CASE WHEN c.conv_id % 4 = 0 THEN true ELSE false END AS forbid_system,
       nullif(regexp_extract(t.text, '(\p{L}{5,})', 1), '') AS must,
       c.conv_id % 2 = 0 AS match_word_boundary, c.conv_id % 5 = 0 AS must_set_comparison,
       c.conv_id % 7 = 0 AS must_have_empty_players_list, CAST(c.conv_id % 3 AS INTEGER) AS min_caveats
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN (SELECT conv_id, text FROM conversations WHERE turn = 0) t ON c.conv_id = t.conv_id""")

_NAME_RE = evals.PROPER_NAME.replace("'", "''")
view("v_checks", ("v_cases", "v_runs"), rf"""
SELECT c.case_id, c.category, c.difficulty, r.judge_overall,
       list_contains(r.tool_calls_made, 'assistant') AS expected_tools_ok,
       NOT (c.forbid_system AND list_contains(r.tool_calls_made, 'system')) AS forbidden_tools_ok,
       CASE WHEN c.must IS NULL THEN true
            WHEN c.match_word_boundary THEN regexp_matches(
              r.analysis || ' ' || array_to_string(regexp_extract_all(r.analysis, '{_NAME_RE}', 1), ' '),
              '(?i)(^|[^\p{{L}}\p{{N}}_])\Q' || c.must || '\E([^\p{{L}}\p{{N}}_]|$)')
            ELSE strpos(lower(r.analysis || ' ' || array_to_string(regexp_extract_all(r.analysis, '{_NAME_RE}', 1), ' ')),
                        lower(c.must)) > 0 END AS mentions_ok,
       r.has_comparison = c.must_set_comparison AS comparison_ok,
       NOT c.must_have_empty_players_list OR len(regexp_extract_all(r.analysis, '{_NAME_RE}', 1)) = 0 AS empty_list_ok,
       r.n_caveats >= c.min_caveats AS caveats_ok
FROM v_cases c JOIN v_runs r ON c.case_id = r.case_id""")


def _checked(c: Context):
    cases, runs = cases_runs(c)
    return evals.hard_checks(cases, runs)


@query("eval_checks")
def _(c: Context):
    """The six hard checks per case and their conjunction."""
    return _checked(c).drop("judge_overall", "category", "difficulty")


oracle("eval_checks", """
SELECT case_id, expected_tools_ok, forbidden_tools_ok, mentions_ok, comparison_ok, empty_list_ok, caveats_ok,
       expected_tools_ok AND forbidden_tools_ok AND mentions_ok AND comparison_ok AND empty_list_ok AND caveats_ok
         AS passed
FROM v_checks""", "v_checks")

_PASSED = ("(expected_tools_ok AND forbidden_tools_ok AND mentions_ok AND comparison_ok AND empty_list_ok "
           "AND caveats_ok)")


@query("eval_summary")
def _(c: Context):
    """Totals, pass rate and mean judge score by GROUPING SETS."""
    return evals.summary(_checked(c))


view("v_eval_summary", ("v_checks",), f"""
SELECT CASE WHEN grouping(category) = 1 AND grouping(difficulty) = 1 THEN 'all'
            WHEN grouping(difficulty) = 1 THEN 'category' ELSE 'difficulty' END AS level,
       CASE WHEN grouping(category) = 1 AND grouping(difficulty) = 1 THEN 'all'
            WHEN grouping(difficulty) = 1 THEN category ELSE difficulty END AS key,
       CAST(count(*) AS BIGINT) AS total, CAST(count_if({_PASSED}) AS BIGINT) AS passed,
       round_even(count_if({_PASSED}) / count(*), 6) AS pass_rate,
       round_even(avg(judge_overall), 6) AS mean_judge_score
FROM v_checks GROUP BY GROUPING SETS ((), (category), (difficulty))""")
oracle("eval_summary", "SELECT * FROM v_eval_summary", "v_eval_summary")


@query("eval_gate")
def _(c: Context):
    """Overall pass rate against the 0.8 threshold."""
    return evals.gate(evals.summary(_checked(c)), 0.8)


oracle("eval_gate", """
SELECT pass_rate, 0.8::DOUBLE AS threshold, pass_rate >= 0.8 AS ok FROM v_eval_summary WHERE level = 'all'""",
       "v_eval_summary")


@query("tool_success")
def _(c: Context):
    """Per run, the last result of each tool wins (max_by on turn);
    success = 1 - failed/total."""
    cv = c.t.conversations
    last = cv.groupBy("conv_id", "role").agg(F.max_by("text", "turn").alias("text"))
    m = last.groupBy(F.col("conv_id").alias("case_id")).agg(F.map_from_entries(F.collect_list(F.struct(
        "role", F.struct(F.when(F.length("text") < 60, F.lit("short answer")).alias("error"))))).alias("results"))
    return evals.tool_success(m)


oracle("tool_success", """
SELECT case_id, CAST(count(*) AS INTEGER) AS tools, CAST(count_if(length(text) < 60) AS INTEGER) AS failed,
       round_even(coalesce(1.0::DOUBLE - count_if(length(text) < 60) / count(*), 1.0::DOUBLE), 6) AS success_rate
FROM (SELECT conv_id AS case_id, role, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id, role) x
GROUP BY case_id""")


@query("judge_contract")
def _(c: Context):
    """Q11: score count equals rubric size; flag overall far from the mean."""
    _cases, runs = cases_runs(c)
    return evals.judge_contract(runs)


oracle("judge_contract", """
SELECT case_id, len(judge_scores) = rubric_size AS count_ok,
       CASE WHEN len(judge_scores) > 0 THEN
            abs(judge_overall - list_reduce(list_prepend(0.0::DOUBLE, list_transform(judge_scores, lambda x: CAST(x AS DOUBLE))),
                                            lambda a, b: a + b) / len(judge_scores)) > 0.5 END AS drift_flag
FROM v_runs""", "v_runs")


@query("pinned_present")
def _(c: Context):
    """Q9: pinned (supplier-derived) names with no matching player -> issues."""
    from tallyframe.plans.group_lookup import name_requests
    return evals.pinned_missing(name_requests(c), c.dashboard, "request_id", "name", "player_id", "web_name")


oracle("pinned_present", """
SELECT r.request_id, r.name FROM v_name_requests r
WHERE NOT EXISTS (SELECT 1 FROM v_dashboard d WHERE strpos(lower(d.web_name), lower(r.name)) > 0)""",
       "v_name_requests", "v_dashboard")


@query("pinned_absent")
def _(c: Context):
    """Q10: proper names extracted from whole document texts that DO occur
    in the raw pages (they must be absent): name and page count."""
    names = evals.extracted_names(c.t.documents, "text")
    names = names.select(F.xxhash64("name").alias("name_id"), "name")
    hits = evals.containment_join(names, c.t.pages, "name_id", "name", "page_id", "html")
    return hits.join(names, "name_id").groupBy("name").agg(F.count(F.lit(1)).alias("pages"))


oracle("pinned_absent", f"""
SELECT n.name, CAST(count(*) AS BIGINT) AS pages FROM (
  SELECT DISTINCT unnest(regexp_extract_all(text, '{_NAME_RE}', 1)) AS name FROM documents) n
JOIN pages p ON strpos(lower(p.html), lower(n.name)) > 0
GROUP BY n.name""")

SESSION_GAP = "12 hours"
SESSION_GAP_S = 12 * 3600


@query("session_windows")
def _(c: Context):
    """T5 batch twin: per-user session windows (a new session after a 12-hour
    gap, scaled like the other windows) with attempt counts."""
    e = c.t.events.select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    g = e.groupBy("user_id", F.session_window("ts", SESSION_GAP).alias("s")).agg(
        F.count(F.lit(1)).alias("attempts"))
    return g.select("user_id", F.date_format("s.start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("session_start"),
                    F.date_format("s.end", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("session_end"), "attempts")


def _sessions_sql(where: str) -> str:
    return f"""
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS session_start,
       strftime(max(ts) + INTERVAL {SESSION_GAP_S} SECOND, '%Y-%m-%d %H:%M:%S.%f') AS session_end,
       CAST(count(*) AS BIGINT) AS attempts
FROM (SELECT user_id, ts, sum(brk) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid
      FROM (SELECT user_id, ts,
                   CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL
                          OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL {SESSION_GAP_S} SECOND
                        THEN 1 ELSE 0 END AS brk
            FROM events WHERE {where}) a) b
GROUP BY user_id, sid"""


oracle("session_windows", _sessions_sql("true"))
# The stream drops the rows that arrive last, behind the watermark.
oracle("stream_session_windows", _sessions_sql("NOT (event_id % 50 = 7 AND day(ts) <= 10)"))


def _admission_sql(short_s: int, short_n: int, long_s: int, long_n: int, retry: bool = True) -> str:
    """W9 oracle: the admission recursion spelled out as a recursive CTE --
    state = the list of accepted timestamps, one step per request."""
    inw = "len(list_filter(r.acc, lambda x: x >= q.t - {w}))"
    s_cnt, l_cnt = inw.format(w=short_s), inw.format(w=long_s)
    keep = f"list_filter(r.acc, lambda x: x >= q.t - {long_s})"
    oldest = "list_min(list_filter(r.acc, lambda x: x >= q.t - {w}))"
    ok = f"({s_cnt} < {short_n} AND {l_cnt} < {long_n})"
    return f"""
WITH RECURSIVE q AS (
  SELECT user_id AS session_id, event_id AS request_id, secs AS t,
         row_number() OVER (PARTITION BY user_id ORDER BY secs, event_id) AS rn FROM v_usage),
r(session_id, rn, request_id, allowed, retry_after, acc) AS (
  SELECT session_id, rn, request_id, true, CAST(NULL AS BIGINT), [t] FROM q WHERE rn = 1
  UNION ALL
  SELECT q.session_id, q.rn, q.request_id, {ok},
         CASE WHEN {s_cnt} >= {short_n} THEN greatest(1, {short_s} - (q.t - {oldest.format(w=short_s)}))
              WHEN {l_cnt} >= {long_n} THEN greatest(1, {long_s} - (q.t - {oldest.format(w=long_s)})) END,
         CASE WHEN {ok} THEN list_append({keep}, q.t) ELSE {keep} END
  FROM r JOIN q ON q.session_id = r.session_id AND q.rn = r.rn + 1)
SELECT session_id, request_id, allowed{", CAST(retry_after AS BIGINT) AS retry_after" if retry else ""} FROM r"""


oracle("rate_admission", _admission_sql(SHORT_S, SHORT_N, LONG_S, LONG_N), "v_usage")

# T4 (streaming, one state per session) must agree with the batch recursion.
oracle("stream_admission", _admission_sql(SHORT_S, SHORT_N, LONG_S, LONG_N, retry=False), "v_usage")
