"""Catalogue entries: cleaning and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.dates import month_key, season_label
from tallyframe.operators import clean, quality
from tallyframe.plans.catalog import query
from tallyframe.plans.context import Context, flat
from tallyframe.plans.oracle import oracle
from tallyframe.plans.oracle_views import view
from tallyframe.sources import standins

# Fixed value: the load timestamp stamped on flattened records (passed in,
# never ``now()`` inside a query).
LOAD_TS = "2025-08-01T00:00:00+00:00"

# --- S3 latest snapshot -----------------------------------------------------


@query("latest_snapshot")
def _(c: Context):
    """S3: events of the newest day-snapshot per event type."""
    ev = c.t.events.select("event_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("snapshot_id"))
    return clean.latest_snapshot(ev, ["event_type"], "snapshot_id")


oracle("latest_snapshot", """
SELECT e.event_id, e.event_type, e.snapshot_id FROM (
  SELECT event_id, event_type, strftime(ts, '%Y-%m-%d') AS snapshot_id FROM events) e
JOIN (SELECT event_type, max(strftime(ts, '%Y-%m-%d')) AS snapshot_id FROM events GROUP BY event_type) m
  ON e.event_type = m.event_type AND e.snapshot_id = m.snapshot_id""")

# --- S4 / W2 -------------------------------------------------------------------

_LI_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
             "l_returnflag", "l_linestatus"]


@query("latest_per_key")
def _(c: Context):
    """Newest lineitem version per (order, line) key (max_by, partial agg)."""
    return clean.latest_per_key(c.t.lineitem, ["l_orderkey", "l_linenumber"], _LI_ORDER)


oracle("latest_per_key", f"""
SELECT * REPLACE (strftime(l_shipdate, '%Y-%m-%d %H:%M:%S.%f') AS l_shipdate) FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                           ORDER BY {', '.join(c + ' DESC' for c in _LI_ORDER)}) = 1""")


@query("dedupe_keep_last")
def _(c: Context):
    """Last event per (user, type) by (ts, event_id)."""
    return clean.latest_per_key(c.t.events, ["user_id", "event_type"], ["ts", "event_id"])


oracle("dedupe_keep_last", """
SELECT * REPLACE (strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts) FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""")


@query("dedupe_keep_first")
def _(c: Context):
    """First event per (user, type) by (ts, event_id) (min_by)."""
    return clean.first_per_key(c.t.events, ["user_id", "event_type"], ["ts", "event_id"])


oracle("dedupe_keep_first", """
SELECT * REPLACE (strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts) FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts ASC, event_id ASC) = 1""")

# --- P1 P2 P3 P4 -------------------------------------------------------------------

_PROPS = T.StructType([T.StructField("k", T.LongType()), T.StructField("id", T.LongType())])


@query("flatten_raw")
def _(c: Context):
    """Raw JSON props parsed with a declared schema, renamed, absent
    keys as typed nulls, load metadata as literals."""
    ev = c.t.events.select("event_id", "user_id", "props", season_label("ts").alias("event_season"),
                           month_key("ts").alias("event_month"))
    return clean.flatten_json(ev, "props", _PROPS, keep_cols=("event_id", "user_id", "event_season", "event_month"),
                              rename={"k": "kick_count", "id": "ref_id"},
                              meta={"season": standins.SEASON, "collected_at": LOAD_TS})


oracle("flatten_raw", f"""
SELECT event_id, user_id,
       CASE WHEN month(ts) >= 8
            THEN CAST(year(ts) AS VARCHAR) || '-' || lpad(CAST((year(ts) + 1) % 100 AS VARCHAR), 2, '0')
            ELSE CAST(year(ts) - 1 AS VARCHAR) || '-' || lpad(CAST(year(ts) % 100 AS VARCHAR), 2, '0') END
         AS event_season,
       strftime(ts, '%Y-%m') AS event_month,
       TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS kick_count,
       TRY_CAST(json_extract_string(props, '$.id') AS BIGINT) AS ref_id,
       '{standins.SEASON}' AS season, '{LOAD_TS}' AS collected_at
FROM events""")


@query("coerce_types")
def _(c: Context):
    """String fields from page URLs coerced with try_cast (bad -> null)."""
    p = c.t.pages.select(
        "page_id",
        F.regexp_extract("url", r"page=([^&#]*)", 1).alias("page_num"),
        F.regexp_extract("url", r"/([a-z]{2})/", 1).alias("lang"),
        F.regexp_extract("url", r"/[a-z]{2}/([^?#]*)", 1).alias("doc_num"))
    return clean.coerce(p, {"page_num": "BIGINT", "doc_num": "BIGINT"})


oracle("coerce_types", r"""
SELECT page_id,
       TRY_CAST(regexp_extract(url, 'page=([^&#]*)', 1) AS BIGINT) AS page_num,
       regexp_extract(url, '/([a-z]{2})/', 1) AS lang,
       TRY_CAST(regexp_extract(url, '/[a-z]{2}/([^?#]*)', 1) AS BIGINT) AS doc_num
FROM pages""")


@query("schema_drift")
def _(c: Context):
    """Unexpected JSON keys (minus ignored names) with record counts."""
    return clean.schema_drift(c.t.events, "props", expected=["id", "ref"], ignored=["code", "photo"])


oracle("schema_drift", """
SELECT key, CAST(count(*) AS BIGINT) AS records FROM (
  SELECT unnest(json_keys(props)) AS key FROM events) k
WHERE key NOT IN ('id', 'ref', 'code', 'photo') GROUP BY key""")

# --- J1 X1 -----------------------------------------------------------------------


@query("name_fallback_join")
def _(c: Context):
    """Second-source stats joined on normalised full name, then short name."""
    ss = clean.coerce(standins.second_source(c.t), {"xG": "DOUBLE", "shots": "DOUBLE"})
    p = c.players.select("player_id", "web_name",
                         F.concat(F.col("first_name"), F.lit(" "), F.col("second_name")).alias("full_name"))
    j = clean.fallback_name_join(p, ss, "full_name", "web_name", "player_name", "src_pos",
                                 ["xG", "shots"], prefix="understat_")
    return j.select("player_id", "matched_on", F.col("understat_xG").alias("understat_xg"),
                    F.col("understat_shots").alias("understat_shots"))


_NORM = "trim(replace(replace(lower({}), '-', ' '), '''', ''))"
view("v_ss_dedup", ("v_second_source",), f"""
SELECT {_NORM.format('player_name')} AS key, TRY_CAST("xG" AS DOUBLE) AS xg, TRY_CAST(shots AS DOUBLE) AS shots
FROM v_second_source
QUALIFY row_number() OVER (PARTITION BY {_NORM.format('player_name')} ORDER BY src_pos) = 1""")

view("v_name_keys", ("v_players",), f"""
SELECT player_id, {_NORM.format('web_name')} AS ns,
       {_NORM.format("first_name || ' ' || second_name")} AS nf FROM v_players""")

oracle("name_fallback_join", """
SELECT p.player_id,
       CASE WHEN f.xg IS NOT NULL THEN 'full' WHEN s.xg IS NOT NULL THEN 'short' END AS matched_on,
       CASE WHEN f.xg IS NOT NULL THEN f.xg ELSE s.xg END AS understat_xg,
       CASE WHEN f.xg IS NOT NULL THEN f.shots ELSE s.shots END AS understat_shots
FROM v_name_keys p LEFT JOIN v_ss_dedup f ON p.nf = f.key LEFT JOIN v_ss_dedup s ON p.ns = s.key""",
       "v_name_keys", "v_ss_dedup")

# --- Q1-Q6 ------------------------------------------------------------------------


def _clean_fixtures(c: Context):
    return c.fixtures.select(F.col("fixture_id").alias("id"), F.col("event").alias("gameweek"),
                             F.col("team_h").alias("home_team"), F.col("team_a").alias("away_team"),
                             F.col("team_h_difficulty").alias("home_difficulty"),
                             F.col("team_a_difficulty").alias("away_difficulty"))


def _clean_players(c: Context):
    return c.players.select(F.col("player_id").alias("id"), "web_name", F.col("team_id").alias("team"),
                            "element_type", "total_points", "minutes", "now_cost")


_CF_SQL = """SELECT fixture_id AS id, event AS gameweek, team_h AS home_team, team_a AS away_team,
       team_h_difficulty AS home_difficulty, team_a_difficulty AS away_difficulty FROM v_fixtures"""


@query("quarantine_split")
def _(c: Context):
    """Q2 Q12 Q13: every fixture record with its valid flag and error list."""
    checked = quality.record_checks(_clean_fixtures(c), quality.FIXTURE_SCHEMA, "id")
    return flat(checked.select("id", (F.size("errors") == 0).alias("is_valid"), "errors"))


oracle("quarantine_split", f"""
SELECT id, gameweek IS NOT NULL AND home_team IS NOT NULL AND away_team IS NOT NULL AS is_valid,
       array_to_string(list_filter([
         CASE WHEN id IS NULL THEN 'null value in required column ''id''' END,
         CASE WHEN gameweek IS NULL THEN 'null value in required column ''gameweek''' END,
         CASE WHEN home_team IS NULL THEN 'null value in required column ''home_team''' END,
         CASE WHEN away_team IS NULL THEN 'null value in required column ''away_team''' END],
         lambda x: x IS NOT NULL), '|') AS errors
FROM ({_CF_SQL}) f""", "v_fixtures")


@query("range_warnings")
def _(c: Context):
    """Q4: one row per value-range warning on the clean player table."""
    return quality.range_warnings(_clean_players(c), quality.PLAYER_SCHEMA, "id")


def _warn(col, op, bound, word):
    return (f"SELECT player_id AS id, 'Record ' || CAST(player_id AS VARCHAR) || ': {col}=' || "
            f"CAST({col} AS VARCHAR) || ' {word} {bound}' AS warning FROM v_players "
            f"WHERE {col} IS NOT NULL AND {col} {op} {bound}")


oracle("range_warnings", "\nUNION ALL\n".join([
    _warn("element_type", "<", 1, "below min"), _warn("element_type", ">", 4, "above max"),
    _warn("total_points", "<", -100, "below min"), _warn("total_points", ">", 500, "above max"),
    _warn("minutes", "<", 0, "below min"), _warn("minutes", ">", 5000, "above max"),
    _warn("now_cost", "<", 30, "below min"), _warn("now_cost", ">", 200, "above max"),
]), "v_players")


@query("uniqueness_report")
def _(c: Context):
    """Q3: duplicated (order, line) keys of lineitem and duplicated fixture ids."""
    a = quality.uniqueness_report(c.t.lineitem, ["l_orderkey", "l_linenumber"], "lineitem")
    b = quality.uniqueness_report(_clean_fixtures(c), ["id"], "fixtures")
    return a.unionByName(b)


def _uniq_sql(src, keys, dataset):
    kexpr = ("CAST({} AS VARCHAR)".format(keys[0]) if len(keys) == 1 else
             "'(' || " + " || ', ' || ".join(f"CAST({k} AS VARCHAR)" for k in keys) + " || ')'")
    kl = ", ".join(keys)
    return f"""(WITH d AS (SELECT {kl}, count(*) AS n FROM {src} GROUP BY {kl} HAVING count(*) > 1),
h AS (SELECT * FROM d ORDER BY {kl} LIMIT 10),
o AS (SELECT {kl}, {kexpr} AS k FROM h, range(CAST(least(n - 1, 10) AS BIGINT)) r ORDER BY {kl} LIMIT 10),
t AS (SELECT CAST(count(*) AS BIGINT) AS duplicated_keys, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS surplus_rows FROM d)
SELECT '{dataset}' AS dataset, '{'+'.join(keys)}' AS key, duplicated_keys, surplus_rows,
  CASE WHEN surplus_rows > 0 THEN 'Duplicate values in ''{'+'.join(keys)}'': [' ||
    coalesce((SELECT string_agg(k, ', ' ORDER BY {kl}) FROM o), '') || ']' ||
    CASE WHEN surplus_rows - 10 > 0 THEN ' (and ' || CAST(surplus_rows - 10 AS VARCHAR) || ' more)' ELSE '' END
  END AS message FROM t)"""


oracle("uniqueness_report", "SELECT * FROM " + _uniq_sql("lineitem", ["l_orderkey", "l_linenumber"], "lineitem")
       + "\nUNION ALL\nSELECT * FROM " + _uniq_sql(f"({_CF_SQL})", ["id"], "fixtures"), "v_fixtures")


@query("validation_status")
def _(c: Context):
    """Q5: valid/partial/invalid roll-up over players and fixtures."""
    return quality.validation_status({
        "players": (_clean_players(c), quality.PLAYER_SCHEMA, "id"),
        "fixtures": (_clean_fixtures(c), quality.FIXTURE_SCHEMA, "id"),
    })


view("v_clean_fixtures", ("v_fixtures",), _CF_SQL)

oracle("validation_status", """
SELECT CASE WHEN sum(i) = 0 THEN 'valid' WHEN sum(v) > 0 THEN 'partial' ELSE 'invalid' END AS status,
       CAST(sum(v) AS BIGINT) AS records_valid, CAST(sum(i) AS BIGINT) AS records_invalid,
       CAST(sum(w) AS BIGINT) AS warnings FROM (
  SELECT CAST(count_if(player_id IS NOT NULL AND web_name IS NOT NULL AND team_id IS NOT NULL
                       AND element_type IS NOT NULL) AS BIGINT) AS v,
         CAST(count_if(NOT (player_id IS NOT NULL AND web_name IS NOT NULL AND team_id IS NOT NULL
                       AND element_type IS NOT NULL)) AS BIGINT) AS i,
         CAST(sum((CASE WHEN element_type < 1 OR element_type > 4 THEN 1 ELSE 0 END)
                + (CASE WHEN total_points < -100 OR total_points > 500 THEN 1 ELSE 0 END)
                + (CASE WHEN minutes < 0 OR minutes > 5000 THEN 1 ELSE 0 END)
                + (CASE WHEN now_cost < 30 OR now_cost > 200 THEN 1 ELSE 0 END)) AS BIGINT) AS w
  FROM v_players
  UNION ALL
  SELECT CAST(count_if(gameweek IS NOT NULL AND home_team IS NOT NULL AND away_team IS NOT NULL) AS BIGINT),
         CAST(count_if(NOT (gameweek IS NOT NULL AND home_team IS NOT NULL AND away_team IS NOT NULL)) AS BIGINT),
         CAST(sum((CASE WHEN gameweek < 1 OR gameweek > 38 THEN 1 ELSE 0 END)
                + (CASE WHEN home_difficulty < 1 OR home_difficulty > 5 THEN 1 ELSE 0 END)
                + (CASE WHEN away_difficulty < 1 OR away_difficulty > 5 THEN 1 ELSE 0 END)) AS BIGINT)
  FROM v_clean_fixtures) a""", "v_players", "v_clean_fixtures")


@query("contract_report")
def _(c: Context):
    """Q6: violations per dashboard contract rule (one aggregate)."""
    return quality.contract_report(c.dashboard)


def _contract_sql():
    parts = []
    for col, kind, arg in quality.DASHBOARD_CONTRACT:
        if kind == "not_null":
            bad = f"{col} IS NULL"
        elif kind == "regex":
            bad = f"{col} IS NOT NULL AND NOT regexp_matches({col}, '{arg}')"
        elif kind == "enum":
            vals = ", ".join(f"'{v}'" for v in arg)
            bad = f"{col} IS NOT NULL AND {col} NOT IN ({vals})"
        else:
            lo, hi = arg
            conds = []
            if lo is not None:
                conds.append(f"{col} < {lo}")
            if hi is not None:
                conds.append(f"{col} > {hi}")
            bad = f"{col} IS NOT NULL AND ({' OR '.join(conds)})"
        parts.append(f"SELECT '{col}' AS \"column\", '{kind}' AS rule, "
                     f"CAST(count_if({bad}) AS BIGINT) AS violations FROM v_dashboard")
    return "\nUNION ALL\n".join(parts)


oracle("contract_report", _contract_sql(), "v_dashboard")


# --- Q12: the raw sets ---------------------------------------------------------------------------

@query("raw_expectations")
def _(c: Context):
    """Q12: raw players and raw fixtures, with faults put in, against their
    expectation sets (allowed values, bounds, required columns)."""
    players = _clean_players(c).drop("now_cost")
    players = players.withColumn("web_name", F.when(F.col("id") % 53 != 0, F.col("web_name")))
    f = c.fixtures.withColumnRenamed("fixture_id", "id")
    fixtures = f.select(
        "id", "event", F.when(F.col("id") % 47 != 0, F.col("team_h")).alias("team_h"), "team_a",
        (F.col("team_h_difficulty") + F.when(F.col("id") % 43 == 0, 4).otherwise(0)).alias("team_h_difficulty"),
        (F.col("team_a_difficulty") - F.when(F.col("id") % 41 == 0, 4).otherwise(0)).alias("team_a_difficulty"))
    out = None
    for name, df, exp in (("players", players, quality.RAW_PLAYER_SCHEMA),
                          ("fixtures", fixtures, quality.RAW_FIXTURE_SCHEMA)):
        assert not quality.missing_columns(df, exp)
        part = quality.record_checks(df, exp, "id").select(
            F.lit(name).alias("dataset"), "id", F.explode(F.concat("errors", "warnings")).alias("message"))
        out = part if out is None else out.unionByName(part)
    return out


def _says(dataset: str, src: str, col: str, bad: str, text: str) -> str:
    return (f"SELECT '{dataset}' AS dataset, id, 'Record ' || CAST(id AS VARCHAR) || ': {col}=' || CAST({col} AS VARCHAR) "
            f"|| ' {text}' AS message FROM {src} WHERE {bad}")


def _null(dataset: str, src: str, col: str) -> str:
    return (f"SELECT '{dataset}', id, 'null value in required column ' || chr(39) || '{col}' || chr(39) FROM {src} "
            f"WHERE {col} IS NULL")


oracle("raw_expectations", """
SELECT * FROM (WITH p AS (
  SELECT player_id AS id, CASE WHEN player_id % 53 <> 0 THEN web_name END AS web_name, team_id AS team, element_type,
         total_points, minutes FROM v_players),
f AS (
  SELECT fixture_id AS id, CASE WHEN fixture_id % 47 <> 0 THEN team_h END AS team_h, team_a,
         team_h_difficulty + CASE WHEN fixture_id % 43 = 0 THEN 4 ELSE 0 END AS team_h_difficulty,
         team_a_difficulty - CASE WHEN fixture_id % 41 = 0 THEN 4 ELSE 0 END AS team_a_difficulty FROM v_fixtures)
""" + "\nUNION ALL\n".join(
    [_says("players", "p", "total_points", "total_points < -10", "below min -10"),
     _says("players", "p", "total_points", "total_points > 300", "above max 300"),
     _says("players", "p", "minutes", "minutes < 0", "below min 0"),
     _says("players", "p", "minutes", "minutes > 5000", "above max 5000"),
     _says("players", "p", "element_type", "element_type NOT IN (1, 2, 3, 4)", "not in allowed values [1, 2, 3, 4]")]
    + [_null("players", "p", x) for x in ("id", "web_name", "team")]
    + [_says("fixtures", "f", x, f"{x} < 1", "below min 1") for x in ("team_h_difficulty", "team_a_difficulty")]
    + [_says("fixtures", "f", x, f"{x} > 5", "above max 5") for x in ("team_h_difficulty", "team_a_difficulty")]
    + [_null("fixtures", "f", x) for x in ("id", "team_h", "team_a")]) + ")", "v_players", "v_fixtures")


# --- X1: names with accents -------------------------------------------------------------------------

# Fixed values of the stand-in: letters of one source and how the fold reads
# them (letters without a decomposition are dropped).
ACCENTED = {"u": "\u00fc", "o": "\u00f6", "e": "\u00e9", "n": "\u00f1", "c": "\u00e7"}


def _accented(name):
    for plain, letter in ACCENTED.items():
        name = F.replace(name, F.lit(plain), F.lit(letter))
    return name


@query("accented_names")
def _(c: Context):
    """Second-source stats joined to names written with accents, with
    an \u00d8 in front (dropped by the fold) and as one ligature letter."""
    ss = clean.coerce(standins.second_source(c.t), {"xG": "DOUBLE", "shots": "DOUBLE"})
    k = F.col("player_id")
    p = c.players.select(
        "player_id", F.when(k % 3 == 0, _accented(F.col("web_name"))).otherwise(F.col("web_name")).alias("web_name"),
        F.concat(F.when(k % 5 == 0, "\u00d8").otherwise(""), _accented(F.col("first_name")), F.lit(" "),
                 F.col("second_name"), F.when(k % 7 == 0, "\ufb01").otherwise("")).alias("full_name"))
    j = clean.fallback_name_join(p, ss, "full_name", "web_name", "player_name", "src_pos", ["xG"])
    return j.select("player_id", "matched_on", clean.normalise_name("full_name").alias("full_key"),
                    clean.normalise_name("web_name").alias("short_key"), F.col("xG").alias("xg"))


oracle("accented_names", f"""
SELECT p.player_id, CASE WHEN f.xg IS NOT NULL THEN 'full' WHEN s.xg IS NOT NULL THEN 'short' END AS matched_on,
       p.nf AS full_key, p.ns AS short_key, CASE WHEN f.xg IS NOT NULL THEN f.xg ELSE s.xg END AS xg
FROM (SELECT player_id, {_NORM.format('web_name')} AS ns,
             {_NORM.format("first_name || ' ' || second_name || CASE WHEN player_id % 7 = 0 THEN 'fi' ELSE '' END")} AS nf
      FROM v_players) p
LEFT JOIN v_ss_dedup f ON p.nf = f.key LEFT JOIN v_ss_dedup s ON p.ns = s.key""", "v_players", "v_ss_dedup")
