"""Stand-in views: the product's entities expressed over the supplied tables.

Each view is a pure, deterministic function of the Parquet tables, so its
size grows with them (customer -> players, nation -> teams, orders ->
fixtures, events -> history/usage/sessions, documents -> articles, ...).
The DuckDB twin of every view lives in ``tallyframe.plans.oracle_views``;
the two must stay definition-for-definition identical.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.numeric import round_half_even, safe_div
from tallyframe.sources.tables import Tables

# Fixed parameters of the stand-in binding.
CURRENT_GW = 70          # fixtures after this event are "remaining"
SEASON = "2025-26"
N_FIXTURE_TEAMS = 26     # away team = o_orderkey % 26: team 25 has no name row
ADVICE_GW = CURRENT_GW + 1


def player_orders(t: Tables) -> DataFrame:
    """Per-customer order aggregates (one partial+final hash aggregate)."""
    o = t.orders
    return (o.groupBy(F.col("o_custkey").alias("player_id"))
            .agg(F.count(F.lit(1)).alias("n_orders"),
                 F.count_if(F.col("o_orderstatus") == "F").alias("n_f"),
                 F.count_if(F.col("o_orderstatus") == "O").alias("n_o"),
                 F.count_if(F.col("o_orderstatus") == "P").alias("n_p"),
                 F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("n_urgent"),
                 F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents"),
                 F.max("o_totalprice").alias("max_price")))


def players(t: Tables) -> DataFrame:
    """Clean+enriched player table (one row per customer)."""
    c = t.customer
    agg = player_orders(t)
    j = c.join(agg, c.c_custkey == agg.player_id, "left")
    k = F.col("c_custkey")
    n = F.coalesce(F.col("n_orders"), F.lit(0)).cast("bigint")
    n_f = F.coalesce(F.col("n_f"), F.lit(0)).cast("bigint")
    n_o = F.coalesce(F.col("n_o"), F.lit(0)).cast("bigint")
    n_p = F.coalesce(F.col("n_p"), F.lit(0)).cast("bigint")
    n_u = F.coalesce(F.col("n_urgent"), F.lit(0)).cast("bigint")
    total_points = n + F.lit(2) * n_f + F.lit(3) * n_u
    risk = F.when(k % 7 == 0, F.lit(None)).otherwise((k % 11).cast("int"))
    even_id = k % 2 == 0
    return j.select(
        k.alias("player_id"),
        F.col("c_name").alias("web_name"),
        F.split_part(F.col("c_name"), F.lit("#"), F.lit(1)).alias("first_name"),
        F.when(k % 13 == 0, F.lit(None)).otherwise(
            F.split_part(F.col("c_name"), F.lit("#"), F.lit(2))).alias("second_name"),
        F.col("c_nationkey").cast("int").alias("team_id"),
        F.when(F.col("c_mktsegment") == "AUTOMOBILE", 1)
         .when(F.col("c_mktsegment") == "BUILDING", 2)
         .when(F.col("c_mktsegment") == "FURNITURE", 3)
         .when(F.col("c_mktsegment") == "MACHINERY", 4)
         .otherwise(5).cast("int").alias("element_type"),
        F.floor(F.greatest(F.col("c_acctbal"), F.lit(0.0)) / 100).cast("bigint").alias("now_cost"),
        total_points.alias("total_points"),
        (F.lit(90) * n_f + F.lit(45) * n_o).alias("minutes"),
        n_f.alias("goals_scored"), n_o.alias("assists"), n_p.alias("clean_sheets"),
        n_u.alias("bonus"),
        round_half_even(F.try_divide(F.try_divide(F.col("cents").cast("double"), n.cast("double")),
                                     F.lit(5000000.0)), 1).alias("form"),
        round_half_even(safe_div(total_points, n), 1).alias("points_per_game"),
        ((k % 100) / F.lit(2.0)).alias("selected_by_percent"),
        (n_o * 1000 + (k % 7) * 2000).alias("transfers_in"),
        (n_p * 1000 + (k % 3) * 1500).alias("transfers_out"),
        F.when(k % 3 == 0, F.lit(None)).otherwise(n_f * F.lit(0.75)).alias("expected_goals"),
        F.when(even_id, F.lit(None)).otherwise((n_f + n_p) * F.lit(0.5)).alias("understat_xg"),
        F.when(even_id, F.lit(None)).otherwise(n_o * F.lit(0.25)).alias("understat_xa"),
        F.when(even_id, F.lit(None)).otherwise(n_p * F.lit(0.5)).alias("understat_npxg"),
        (n_f * F.lit(10.5)).alias("influence"),
        (n_o * F.lit(7.25)).alias("creativity"),
        (n_p * F.lit(12.0)).alias("threat"),
        round_half_even(F.col("max_price") / F.lit(10000.0), 1).alias("ict_index"),
        F.when(k % 5 == 0, F.lit(None)).otherwise(
            F.concat(F.col("c_name"), F.lit(" has "), n.cast("string"),
                     F.lit(" orders and steady output."))).alias("summary"),
        F.when(k % 3 == 0, "improving").when(k % 3 == 1, "stable")
         .otherwise("declining").alias("form_trend"),
        ((k % 10) / F.lit(10.0)).alias("form_confidence"),
        risk.alias("injury_risk"),
        F.when(risk.isNull(), F.lit(None)).otherwise(
            F.concat(F.lit("risk "), risk.cast("string"))).alias("injury_reasoning"),
        F.when(k % 4 == 0, "positive").when(k % 4 == 1, "negative")
         .when(k % 4 == 2, "neutral").otherwise("mixed").alias("sentiment_label"),
        (((k % 21) - 10) / F.lit(10.0)).alias("sentiment_score"),
        F.array(F.lower(F.col("c_mktsegment")),
                F.when(n_u > 2, F.lit("urgent")).otherwise(F.lit("steady"))).alias("key_themes"),
        F.array((F.lit(CURRENT_GW + 1) + k % 5).cast("int"),
                (F.lit(CURRENT_GW + 3) + k % 5).cast("int")).alias("best_gameweeks"),
        F.concat(F.lit("Target GW"), (F.lit(CURRENT_GW + 1) + k % 10).cast("string"))
         .alias("fixture_recommendation"),
        k.alias("src_pos"),
    )


def teams(t: Tables) -> DataFrame:
    """Team look-up (team_id, team_name, team_short) from ``nation``."""
    n = t.nation
    return n.select(
        F.col("n_nationkey").cast("int").alias("team_id"),
        F.col("n_name").alias("team_name"),
        F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("team_short"),
    )


def event_start(event: int) -> str:
    """First day of a stand-in gameweek (event = months since 1995-01, 1-based)."""
    y, m = divmod(event - 1, 12)
    return f"{1995 + y:04d}-{m + 1:02d}-01"


def fixtures(t: Tables, min_event: int | None = None, max_event: int | None = None) -> DataFrame:
    """Match list: one row per order (home = customer's nation).

    ``min_event``/``max_event`` restrict the events as a range on the raw
    order date -- the event is a monotone function of the date -- so the
    predicate reaches the Parquet scan (PushedFilters / row-group skipping)
    instead of being applied after the join."""
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    if min_event is not None:
        o = o.where(F.col("o_orderdate") >= F.lit(event_start(min_event)).cast("timestamp_ntz"))
    if max_event is not None:
        o = o.where(F.col("o_orderdate") < F.lit(event_start(max_event + 1)).cast("timestamp_ntz"))
    c = t.customer.select("c_custkey", "c_nationkey")
    k = F.col("o_orderkey")
    j = o.join(c, o.o_custkey == c.c_custkey, "inner")
    # Every 29th order is "unscheduled" (null event), as in the raw feed.
    ev = F.when(k % 29 == 0, F.lit(None)).otherwise(
        ((F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate")).cast("int"))
    out = j.select(
        k.alias("fixture_id"),
        ev.alias("event"),
        F.col("c_nationkey").cast("int").alias("team_h"),
        (k % N_FIXTURE_TEAMS).cast("int").alias("team_a"),
        F.when(k % 17 == 0, F.lit(None)).otherwise((k % 5 + 1).cast("int")).alias("team_h_difficulty"),
        (F.col("o_custkey") % 5 + 1).cast("int").alias("team_a_difficulty"),
        F.when(k % 23 == 0, F.lit(None)).otherwise(F.col("o_orderdate")).alias("kickoff_time"),
    )
    return out.where(F.col("team_h") != F.col("team_a"))


def second_source(t: Tables) -> DataFrame:
    """Second-source stats keyed by a display name, numbers as strings.

    Name variants per customer: k%3==0 full name upper-cased with a hyphen
    (matches the normalised full name), k%3==1 the short name (fallback
    path), k%3==2 an unmatched name.  Every 10th customer appears twice
    (first occurrence by ``src_pos`` wins).
    """
    c = t.customer
    agg = player_orders(t)
    j = c.join(agg, c.c_custkey == agg.player_id, "left")
    k = F.col("c_custkey")
    n_f = F.coalesce(F.col("n_f"), F.lit(0))
    n_o = F.coalesce(F.col("n_o"), F.lit(0))
    name = (F.when(k % 3 == 0, F.upper(F.concat(F.split_part(F.col("c_name"), F.lit("#"), F.lit(1)), F.lit("-"),
                                                  F.split_part(F.col("c_name"), F.lit("#"), F.lit(2)))))
             .when(k % 3 == 1, F.col("c_name"))
             .otherwise(F.concat(F.lit("O'"), F.col("c_name"))))
    base = j.select(name.alias("player_name"),
                    F.concat(n_f.cast("string"), F.lit(".5")).alias("xG"),
                    F.when(k % 17 == 0, F.lit("n/a")).otherwise(n_o.cast("string")).alias("shots"),
                    (k * 2).alias("src_pos"))
    dup = j.where(k % 10 == 0).select(name.alias("player_name"), F.lit("99.0").alias("xG"),
                                      F.lit("0").alias("shots"), (k * 2 + 1).alias("src_pos"))
    return base.unionByName(dup)


ARTICLE_BASE_DATE = "2024-01-01"


def articles(t: Tables) -> DataFrame:
    """News articles from ``documents``: partition date = base + doc_id % 7
    days; every 9th is published a day later than its partition."""
    d = t.documents
    k = F.col("doc_id")
    day = F.date_add(F.lit(ARTICLE_BASE_DATE).cast("date"), (k % 7).cast("int"))
    return d.select("doc_id", F.col("text").alias("summary"), F.lit("").alias("title"), "source", "lang",
                    day.alias("date"),
                    F.when(k % 9 == 0, F.date_add(day, 1)).otherwise(day).alias("published"))


def enrichment_results(t: Tables) -> DataFrame:
    """Long-form enricher outputs from ``labels``: two enrichers per labelled
    document; every 11th toxic result is null (failed item)."""
    lb = t.labels
    k = F.col("doc_id")
    q = lb.select("doc_id", F.lit("quality").alias("enricher"),
                  F.struct(F.col("quality").alias("score"),
                           F.when(F.col("quality") == 1, "good").otherwise("poor").alias("label")).alias("enrichment"),
                  k.alias("seq"))
    x = lb.select("doc_id", F.lit("toxic").alias("enricher"),
                  F.when(k % 11 == 0, F.lit(None)).otherwise(
                      F.struct(F.col("toxic").alias("score"),
                               F.when(F.col("toxic") == 1, "toxic").otherwise("clean").alias("label")))
                  .alias("enrichment"), k.alias("seq"))
    return q.unionByName(x)


HISTORY_SEASON = SEASON


def history(t: Tables) -> DataFrame:
    """Per-gameweek player history from ``events``: gameweek = day of month,
    player = user; score = mean event value (exact decimal mean, 1 dp)."""
    from tallyframe.operators.ranking import min_rank_desc_bounded

    e = t.events
    g = e.groupBy(F.col("user_id").alias("player_id"), F.dayofmonth("ts").cast("int").alias("gameweek")).agg(
        F.sum(F.col("value").cast("decimal(18,2)")).alias("_s"), F.count(F.lit(1)).alias("_n"),
        F.min("value").alias("_min"))
    h = g.select("player_id", "gameweek", F.lit(HISTORY_SEASON).alias("season"),
                 F.bround(F.col("_s").cast("double") / F.col("_n").cast("double"), 1).alias("composite_score"),
                 F.bround(F.col("_min") / 10, 1).alias("price"),
                 F.col("_n").cast("double").alias("ownership_pct"),
                 (((F.col("player_id") % 21) - 10) / F.lit(10.0)).alias("sentiment_score"))
    return min_rank_desc_bounded(h, "composite_score", "composite_rank", ["season", "gameweek"])
