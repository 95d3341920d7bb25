"""Evaluation roll-ups over stored runs: hard checks per case, pass rates by
grouping sets, the threshold gate, tool success rates, judge-verdict
contracts, and pinned-name presence/absence checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.text import word_match  # noqa: F401 - re-exported
from tallyframe.operators import contracts
from tallyframe.operators.calls import call_in_batches
from tallyframe.operators.contracts import checked_json
from tallyframe.operators.enrich import containment_join

# Fixed value: proper-name pattern used to find names in free text.
PROPER_NAME = r"\b([A-Z][a-z]+(?:[\s-][A-Z][a-z]+)+)\b"


def hard_checks(cases: DataFrame, runs: DataFrame) -> DataFrame:
    """A13 + U3: the six checks of every case against its stored run, as
    boolean columns plus their conjunction (one join, one projection)."""
    j = cases.join(runs, "case_id", "inner")
    called = F.col("tool_calls_made")
    expected_ok = F.size(F.array_except(F.col("expected_tools"), called)) == 0
    forbidden_ok = F.size(F.array_intersect(F.col("forbidden_tools"), called)) == 0
    text = F.concat_ws(" ", F.col("analysis"), F.array_join(F.col("player_names"), " "))
    found = F.forall(F.col("must_mention_players"), lambda n: F.when(
        F.col("match_word_boundary"), word_match(text, n)).otherwise(F.lower(text).contains(F.lower(n))))
    comparison_ok = F.col("has_comparison") == F.col("must_set_comparison")
    empty_ok = ~F.col("must_have_empty_players_list") | (F.size("player_names") == 0)
    caveats_ok = F.size("caveats") >= F.col("min_caveats")
    checks = [expected_ok.alias("expected_tools_ok"), forbidden_ok.alias("forbidden_tools_ok"),
              found.alias("mentions_ok"), comparison_ok.alias("comparison_ok"), empty_ok.alias("empty_list_ok"),
              caveats_ok.alias("caveats_ok")]
    out = j.select("case_id", "category", "difficulty", "judge_overall", *checks)
    passed = F.col("expected_tools_ok")
    for c in ["forbidden_tools_ok", "mentions_ok", "comparison_ok", "empty_list_ok", "caveats_ok"]:
        passed = passed & F.col(c)
    return out.select("*", passed.alias("passed"))


def filter_cases(cases: DataFrame, ids=None, categories=None, max_cases: int | None = None) -> DataFrame:
    """Explicit ids win over categories; then the first ``max_cases`` by
    id.  A filter that selects nothing is an error."""
    if ids:
        cases = cases.where(F.col("case_id").isin(list(ids)))
    elif categories:
        cases = cases.where(F.col("category").isin(list(categories)))
    if (ids or categories) and cases.isEmpty():
        raise ValueError(f"no cases match {'ids' if ids else 'categories'} {sorted(ids or categories)}")
    return cases.orderBy("case_id").limit(max_cases) if max_cases else cases


def summary(checked: DataFrame) -> DataFrame:
    """Total, passed, pass rate and mean judge score overall, by
    category and by difficulty -- ONE pass with GROUPING SETS (cube over
    the two keys, then the three wanted sets kept)."""
    g = checked.cube("category", "difficulty").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("passed").alias("passed"),
        F.avg("judge_overall").alias("_mj"), F.grouping_id().alias("_gid"))
    g = g.where(F.col("_gid").isin(1, 2, 3))
    level = F.when(F.col("_gid") == 3, "all").when(F.col("_gid") == 1, "category").otherwise("difficulty")
    key = F.when(F.col("_gid") == 3, F.lit("all")).when(F.col("_gid") == 1, F.col("category")) \
           .otherwise(F.col("difficulty"))
    return g.select(level.alias("level"), key.alias("key"), "total", "passed",
                    F.bround(F.col("passed") / F.col("total"), 6).alias("pass_rate"),
                    F.bround("_mj", 6).alias("mean_judge_score"))


def gate(summary_df: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Ok iff the overall pass rate reaches the threshold."""
    s = summary_df.where(F.col("level") == "all")
    return s.select("pass_rate", F.lit(threshold).alias("threshold"),
                    (F.col("pass_rate") >= threshold).alias("ok"))


def tool_success(results: DataFrame, map_col: str = "results") -> DataFrame:
    """1 - failed/total over a map of tool results (1.0 when empty)."""
    vals = F.map_values(F.col(map_col))
    failed = F.size(F.filter(vals, lambda v: v.getField("error").isNotNull()))
    total = F.size(vals)
    rate = F.coalesce(F.lit(1.0) - F.try_divide(failed.cast("double"), total.cast("double")), F.lit(1.0))
    return results.select("case_id", total.alias("tools"), failed.alias("failed"),
                          F.bround(rate, 6).alias("success_rate"))


# --- keys of tool calls, one fold per run (F-str9, A15) ----------------------------------------

KEY_CHARS = 80


def canonical_text(value: Column, depth: int = 4) -> Column:
    """Readable text of a VARIANT that does not depend on the order of keys:
    keys sorted at every level, ``{k=v,...}`` and ``[v,...]``; scalars as the
    product's labels print them (True, False, None).  Levels below ``depth``
    are printed as JSON, whose keys a VARIANT holds in sorted order."""
    kind = F.schema_of_variant(value)
    plain = (F.when(F.is_variant_null(value), "None")
             .when(kind == "BOOLEAN", F.initcap(F.try_variant_get(value, "$", "string")))
             .otherwise(F.try_variant_get(value, "$", "string")))
    if not depth:
        return plain
    pairs = F.transform(F.array_sort(F.map_entries(F.transform_values(
        F.try_variant_get(value, "$", "map<string,variant>"), lambda _, v: canonical_text(v, depth - 1)))),
        lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    items = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda v: canonical_text(v, depth - 1))
    return (F.when(kind.startswith("OBJECT<"), F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}")))
            .when(kind.startswith("ARRAY<"), F.concat(F.lit("["), F.array_join(items, ","), F.lit("]")))
            .otherwise(plain))


def result_key(name: Column, args: Column) -> Column:
    """F-str9: ``name(k=v,...)`` with sorted arguments, ``name`` without any,
    ``name#dddd`` (of a digest, the same in every run) beyond 80 characters."""
    text = F.regexp_replace(canonical_text(args), r"^\{|\}$", "")
    short = F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), F.lit(10_000))
    none = args.isNull() | (F.coalesce(text, F.lit("")) == "")
    return (F.when(none, name).when(F.length(text) > KEY_CHARS, F.concat(name, F.lit("#"), short.cast("string")))
            .otherwise(F.concat(name, F.lit("("), text, F.lit(")"))))


def run_scores(calls: DataFrame, runs: DataFrame) -> DataFrame:
    """The three scores of every run and its repeated calls.

    ``calls``: ``case_id``, ``seq``, ``name``, ``args`` (JSON text or null),
    ``error`` (of the call's result).  A call with the key of an earlier one
    replaces its result.  ``runs``: ``case_id``, ``answered``, ``error``,
    ``iterations``.  Both aggregates are partial before they are exchanged, so
    a run with very many calls is no hot group.
    """
    keyed = calls.select("case_id", "seq", "error", result_key(
        F.col("name"), F.try_parse_json("args")).alias("key"))
    last = keyed.groupBy("case_id", "key").agg(
        F.count("*").alias("_n"), F.max_by(F.struct("error"), "seq").alias("_last"))
    fold = last.groupBy("case_id").agg(
        F.sum("_n").alias("calls"), F.count("*").alias("results"),
        F.count_if(F.col("_last.error").isNotNull()).alias("failed"))
    n = F.coalesce("results", F.lit(0))
    rate = F.when(n > 0, 1.0 - F.col("failed") / n).otherwise(1.0)
    return runs.join(fold, "case_id", "left").select(
        "case_id", F.coalesce("calls", F.lit(0)).cast("long").alias("calls"), n.cast("long").alias("results"),
        (F.coalesce("calls", F.lit(0)) - n).cast("long").alias("repeated"),
        F.when(F.col("answered") & F.col("error").isNull(), 1.0).otherwise(0.0).alias("output_valid"),
        F.coalesce("iterations", F.lit(0)).cast("double").alias("iterations_used"),
        F.bround(rate, 4).alias("tool_success_rate"))


def judge_runs(runs: DataFrame, judge, fields, batch_size: int = 10) -> DataFrame:
    """An injected judge over stored runs (``case_id``, ``rubric_size`` and
    ``fields``), in batches; its answers checked against the verdict contract
    and by Q11.  ``count_ok`` and ``drift_flag`` are null without a valid
    verdict, ``error`` says why the judge gave none."""
    asked = call_in_batches(runs, judge, fields, ["case_id", "rubric_size"], batch_size)
    checked = checked_json(asked.where("error IS NULL"), "answer", contracts.JUDGE_VERDICT)
    verdict = F.when(F.col("is_valid"), F.try_parse_json("answer"))
    scores = F.transform(F.try_variant_get(verdict, "$.scores", "array<variant>"),
                         lambda x: F.try_variant_get(x, "$.score", "double"))
    judged = checked.select(
        "case_id", "error", "is_valid", F.array_join("broken", "|").alias("broken"), "rubric_size",
        scores.alias("judge_scores"), F.try_variant_get(verdict, "$.overall", "double").alias("judge_overall"))
    rules = judge_contract(judged, keep=["error", "is_valid", "broken"])
    failed = asked.where("error IS NOT NULL").select(
        "case_id", "error", F.lit(False).alias("is_valid"), F.lit("").alias("broken"),
        F.lit(None).cast("boolean").alias("count_ok"), F.lit(None).cast("boolean").alias("drift_flag"))
    return rules.select(*failed.columns).unionByName(failed)


def judge_contract(runs: DataFrame, keep=()) -> DataFrame:
    """Q11: the verdict must score every rubric bullet; flag an overall that
    drifts more than 0.5 from the mean of the scores."""
    n = F.size("judge_scores")
    mean = F.aggregate("judge_scores", F.lit(0.0), lambda a, x: a + x) / n
    return runs.select("case_id", *keep, (n == F.col("rubric_size")).alias("count_ok"),
                       F.when(n > 0, F.abs(F.col("judge_overall") - mean) > 0.5).alias("drift_flag"))


def pinned_missing(names: DataFrame, table: DataFrame, name_id: str, name_col: str,
                   key: str, text_col: str) -> DataFrame:
    """Q9: pinned names with no containing row in ``table`` (issue rows)."""
    hits = containment_join(names, table, name_id, name_col, key, text_col).select(name_id).distinct()
    return names.join(hits, name_id, "left_anti")


def extracted_names(texts: DataFrame, text_col: str) -> DataFrame:
    """Q10 name extraction over WHOLE texts (``regexp_extract_all``)."""
    return texts.select(F.explode(F.regexp_extract_all(F.col(text_col), F.lit(PROPER_NAME), 1)).alias("name")) \
                .distinct()
