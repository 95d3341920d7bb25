"""Data-quality operators: expectations, quarantine split, range warnings,
uniqueness, status roll-up and output contracts.

All record-level rules of a dataset are evaluated in ONE projection (arrays
of rule results), dataset-level aggregates in ONE aggregate; uniqueness is
the only rule that needs its own shuffle (group by the key).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Expectations:
    """A declarative expectation set (column names of the checked frame)."""

    column_presence: tuple = ()
    not_null: tuple = ()
    unique: tuple = ()
    # column -> {"min": x, "max": y} or {"allowed": [...]}
    value_ranges: dict = field(default_factory=dict)


# Expectation sets of the clean and the raw player and fixture tables.
PLAYER_SCHEMA = Expectations(
    column_presence=("id", "web_name", "team", "element_type", "total_points", "minutes", "now_cost"),
    not_null=("id", "web_name", "team", "element_type"),
    unique=("id",),
    value_ranges={
        "element_type": {"min": 1, "max": 4},
        "total_points": {"min": -100, "max": 500},
        "minutes": {"min": 0, "max": 5000},
        "now_cost": {"min": 30, "max": 200},
    },
)
RAW_PLAYER_SCHEMA = Expectations(
    column_presence=("id", "web_name", "team", "element_type", "total_points", "minutes"),
    not_null=("id", "web_name", "team"),
    unique=("id",),
    value_ranges={
        "total_points": {"min": -10, "max": 300},
        "minutes": {"min": 0, "max": 5000},
        "element_type": {"allowed": [1, 2, 3, 4]},
    },
)
RAW_FIXTURE_SCHEMA = Expectations(
    column_presence=("id", "event", "team_h", "team_a", "team_h_difficulty", "team_a_difficulty"),
    not_null=("id", "team_h", "team_a"),
    unique=("id",),
    value_ranges={
        "team_h_difficulty": {"min": 1, "max": 5},
        "team_a_difficulty": {"min": 1, "max": 5},
    },
)
FIXTURE_SCHEMA = Expectations(
    column_presence=("id", "gameweek", "home_team", "away_team", "home_difficulty", "away_difficulty"),
    not_null=("id", "gameweek", "home_team", "away_team"),
    unique=("id",),
    value_ranges={
        "gameweek": {"min": 1, "max": 38},
        "home_difficulty": {"min": 1, "max": 5},
        "away_difficulty": {"min": 1, "max": 5},
    },
)


def _lit_text(v) -> str:
    return repr(v) if not isinstance(v, str) else v


def missing_columns(df: DataFrame, exp: Expectations) -> list[str]:
    """Q1/Q14: required columns absent from the schema (a driver-side set
    difference on metadata; no data is read)."""
    return [c for c in exp.column_presence if c not in df.columns]


def record_checks(df: DataFrame, exp: Expectations, id_col: str = "id") -> DataFrame:
    """Q2+Q4: add ``errors`` (not-null failures) and ``warnings`` (range
    violations, nulls skipped) as arrays, in one projection."""
    errs = [F.when(F.col(c).isNull(), F.lit(f"null value in required column '{c}'"))
            for c in exp.not_null if c in df.columns]
    warns = []
    for c, rule in exp.value_ranges.items():
        if c not in df.columns:
            continue
        v = F.col(c)
        head = F.concat(F.lit("Record "), F.col(id_col).cast("string"), F.lit(f": {c}="), v.cast("string"))
        if "allowed" in rule:
            allowed = list(rule["allowed"])
            warns.append(F.when(v.isNotNull() & ~v.isin(allowed),
                                F.concat(head, F.lit(f" not in allowed values {allowed}"))))
        else:
            if "min" in rule:
                warns.append(F.when(v.isNotNull() & (v < F.lit(rule["min"])),
                                    F.concat(head, F.lit(f" below min {_lit_text(rule['min'])}"))))
            if "max" in rule:
                warns.append(F.when(v.isNotNull() & (v > F.lit(rule["max"])),
                                    F.concat(head, F.lit(f" above max {_lit_text(rule['max'])}"))))
    nn = lambda xs: F.filter(F.array(*xs), lambda x: x.isNotNull()) if xs else F.array().cast("array<string>")
    return df.select("*", nn(errs).alias("errors"), nn(warns).alias("warnings"))


def quarantine_split(df: DataFrame, exp: Expectations, id_col: str = "id"):
    """Q2: (valid, failed) frames.  ``failed`` carries the record as JSON and
    its error list (the dead-letter shape).  Both come from one checked
    projection; persist it when both sides are written."""
    checked = record_checks(df, exp, id_col)
    ok = F.size("errors") == 0
    valid = checked.where(ok).drop("errors", "warnings")
    cols = [c for c in df.columns]
    failed = checked.where(~ok).select(F.col(id_col), F.to_json(F.struct(*cols)).alias("record"), "errors")
    return valid, failed


def range_warnings(df: DataFrame, exp: Expectations, id_col: str = "id") -> DataFrame:
    """Q4: the violations table (one row per warning), instead of a log line."""
    checked = record_checks(df, exp, id_col)
    return checked.select(F.col(id_col), F.explode("warnings").alias("warning"))


def uniqueness_report(df: DataFrame, key_cols, dataset: str, sample: int = 10) -> DataFrame:
    """Q3: duplicated key values.  One aggregate by key; the message lists the
    first ``sample`` repeated occurrences (key order) "(and n more)".

    A key holding a third of all rows is fine: the count is a partial
    (map-side) aggregate, so the hot key ships one partial count per task.
    """
    key_cols = list(key_cols)
    key = (F.col(key_cols[0]).cast("string") if len(key_cols) == 1
           else F.concat(F.lit("("), F.concat_ws(", ", *[F.col(c).cast("string") for c in key_cols]), F.lit(")")))
    counts = df.groupBy(*key_cols).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    totals = counts.agg(F.count(F.lit(1)).alias("duplicated_keys"),
                        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("surplus_rows"))
    # The sample is the feature: the first ``sample`` duplicated keys (a
    # map-side top-k), each repeated at most ``sample`` times, then cut again.
    head = counts.orderBy(*key_cols).limit(sample)
    occ = head.select(*key_cols, key.alias("_k"),
                      F.explode(F.array_repeat(F.lit(1), F.least(F.col("_n") - 1, F.lit(sample)).cast("int")))
                      .alias("_one"))
    first = occ.orderBy(*key_cols).limit(sample)
    listed = first.agg(F.array_join(F.array_sort(F.collect_list(F.struct(*key_cols, "_k"))).getField("_k"), ", ")
                       .alias("_list"))
    rep = totals.crossJoin(listed)
    more = F.col("surplus_rows") - F.lit(sample)
    msg = F.concat(F.lit(f"Duplicate values in '{'+'.join(key_cols)}': ["), F.coalesce(F.col("_list"), F.lit("")),
                   F.lit("]"), F.when(more > 0, F.concat(F.lit(" (and "), more.cast("string"), F.lit(" more)")))
                   .otherwise(F.lit("")))
    return rep.select(F.lit(dataset).alias("dataset"), F.lit("+".join(key_cols)).alias("key"),
                      "duplicated_keys", "surplus_rows",
                      F.when(F.col("surplus_rows") > 0, msg).alias("message"))


def validation_status(datasets: dict) -> DataFrame:
    """Q5: valid/partial/invalid over several datasets.

    ``datasets`` maps name -> (frame, expectations, id column).  Each is
    reduced to (valid, invalid) counts in one aggregate; the roll-up is a
    union of one-row frames.
    """
    parts = []
    for name, (df, exp, id_col) in datasets.items():
        checked = record_checks(df, exp, id_col)
        parts.append(checked.agg(F.lit(name).alias("dataset"),
                                 F.count_if(F.size("errors") == 0).alias("records_valid"),
                                 F.count_if(F.size("errors") > 0).alias("records_invalid"),
                                 F.sum(F.size("warnings")).cast("bigint").alias("warnings")))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    tot = u.agg(F.sum("records_valid").cast("bigint").alias("records_valid"),
                F.sum("records_invalid").cast("bigint").alias("records_invalid"),
                F.sum("warnings").cast("bigint").alias("warnings"))
    status = (F.when(F.col("records_invalid") == 0, "valid")
              .when(F.col("records_valid") > 0, "partial").otherwise("invalid"))
    return tot.select(status.alias("status"), "records_valid", "records_invalid", "warnings")


# The dashboard output contract (column, rule) pairs.
DASHBOARD_CONTRACT = [
    ("position", "regex", r"^(GKP|DEF|MID|FWD)$"),
    ("composite_score", "range", (0.0, 100.0)),
    ("composite_rank", "range", (1, None)),
    ("form_trend", "enum", ("improving", "stable", "declining")),
    ("form_confidence", "range", (0.0, 1.0)),
    ("injury_risk", "range", (0, 10)),
    ("sentiment_label", "enum", ("positive", "negative", "neutral", "mixed")),
    ("sentiment_score", "range", (-1.0, 1.0)),
    ("price", "range", (0.0, None)),
    ("player_id", "not_null", None),
    ("web_name", "not_null", None),
]


def _rule_ok(col: str, kind: str, arg):
    c = F.col(col)
    if kind == "not_null":
        return c.isNotNull()
    if kind == "regex":
        return c.isNull() | c.rlike(arg)
    if kind == "enum":
        return c.isNull() | c.isin(list(arg))
    lo, hi = arg
    ok = F.lit(True)
    if lo is not None:
        ok = ok & (c >= F.lit(lo))
    if hi is not None:
        ok = ok & (c <= F.lit(hi))
    return c.isNull() | ok


def contract_report(df: DataFrame, contract=DASHBOARD_CONTRACT) -> DataFrame:
    """Q6: violations per rule, all rules in ONE aggregate, then unpivoted."""
    aggs = [F.count_if(~_rule_ok(c, k, a)).alias(f"r{i}") for i, (c, k, a) in enumerate(contract)]
    one = df.agg(*aggs)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(k).alias("rule"),
                               F.col(f"r{i}").alias("violations"))
                      for i, (c, k, a) in enumerate(contract)])
    return one.select(F.inline(pairs))
