"""Catalogue entries: look-ups, vectors and squads (P18-P23 J9 J11 S14 S16
W3 W11 J10 S17 A33)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.operators import lookup
from tallyframe.plans.catalog import query
from tallyframe.plans.context import Context
from tallyframe.plans.oracle import oracle
from tallyframe.plans.oracle_views import view

# --- request tables derived from the supplied tables ------------------------------


def name_requests(c: Context):
    """One look-up per supplier: an 8-digit id fragment (matches several
    players), or an unknown name for every third supplier."""
    k = F.col("s_suppkey")
    return c.t.supplier.select(
        k.alias("request_id"),
        F.when(k % 3 == 0, F.concat(F.lit("Zz"), F.col("s_name")))
         .otherwise(F.lpad(k.cast("string"), 8, "0")).alias("name"))


view("v_name_requests", (), """
SELECT s_suppkey AS request_id,
       CASE WHEN s_suppkey % 3 = 0 THEN 'Zz' || s_name ELSE lpad(CAST(s_suppkey AS VARCHAR), 8, '0') END AS name
FROM supplier""")

view("v_best_match", ("v_name_requests", "v_dashboard"), """
SELECT r.request_id, r.name,
       arg_max(d.player_id, row(d.total_points, -d.player_id)) AS player_id
FROM v_name_requests r LEFT JOIN v_dashboard d ON strpos(lower(d.web_name), lower(r.name)) > 0
GROUP BY r.request_id, r.name""")


def _best(c: Context):
    return lookup.name_lookup(c.dashboard_shared, name_requests(c))


@query("name_lookup")
def _(c: Context):
    """Best player per requested name; not-found kept."""
    return _best(c)


oracle("name_lookup", """
SELECT request_id, name, player_id, player_id IS NOT NULL AS found FROM v_best_match""", "v_best_match")

# Fixed value: the note attached to the single-number outlook.
OUTLOOK_NOTE = "Single aggregate difficulty score; per-GW breakdown not yet available."


@query("outlook_lookup")
def _(c: Context):
    """P20: fixture outlook projection for each found request."""
    b = _best(c).where("found").join(c.dashboard_shared, "player_id", "inner")
    return b.select("request_id", F.col("web_name").alias("player"), F.col("team_name").alias("team"),
                    F.col("fdr_next_3").alias("difficulty"), F.lit(OUTLOOK_NOTE).alias("note"))


oracle("outlook_lookup", f"""
SELECT b.request_id, d.web_name AS player, d.team_name AS team, d.fdr_next_3 AS difficulty,
       '{OUTLOOK_NOTE}' AS note
FROM v_best_match b JOIN v_dashboard d ON b.player_id = d.player_id""", "v_best_match", "v_dashboard")


@query("injury_lookup")
def _(c: Context):
    """injury/form projection for each found request."""
    b = _best(c).where("found").join(c.dashboard_shared, "player_id", "inner")
    return b.select("request_id", "web_name", "injury_risk", "form_trend", F.col("llm_summary").alias("summary"))


oracle("injury_lookup", """
SELECT b.request_id, d.web_name, d.injury_risk, d.form_trend, d.llm_summary AS summary
FROM v_best_match b JOIN v_dashboard d ON b.player_id = d.player_id""", "v_best_match", "v_dashboard")


def criteria_requests(c: Context):
    """One criteria request per region: position cycles (one "any"), price
    cap and form floor grow with the key, every other asks for '_1' teams."""
    k = F.col("r_regionkey")
    pos = F.element_at(F.array(*[F.lit(x) for x in ["gkp", "def", "mid", "fwd"]] + [F.lit(None)]),
                       (k % 5 + 1).cast("int"))
    return c.t.region.select(k.cast("bigint").alias("request_id"), pos.alias("position"),
                             (F.lit(4.0) + k * F.lit(1.5)).alias("max_price"),
                             (k * F.lit(1.0)).alias("min_form"),
                             F.when(k % 2 == 0, F.lit("_1")).alias("team"), F.lit(20).alias("lim"))


@query("criteria_search")
def _(c: Context):
    """Per request the top 20 matching players by points."""
    return lookup.criteria_search(c.dashboard_shared, criteria_requests(c))


oracle("criteria_search", """
SELECT request_id, player_id, total_points, rank FROM (
  SELECT r.request_id, r.lim, d.player_id, d.total_points,
         CAST(row_number() OVER (PARTITION BY r.request_id ORDER BY d.total_points DESC, d.player_id) AS INTEGER) AS rank
  FROM (SELECT CAST(r_regionkey AS BIGINT) AS request_id,
               CASE r_regionkey % 5 WHEN 0 THEN 'GKP' WHEN 1 THEN 'DEF' WHEN 2 THEN 'MID' WHEN 3 THEN 'FWD' END AS position,
               4.0::DOUBLE + r_regionkey * 1.5::DOUBLE AS max_price, r_regionkey * 1.0::DOUBLE AS min_form,
               CASE WHEN r_regionkey % 2 = 0 THEN '_1' END AS team, 20 AS lim FROM region) r
  JOIN v_dashboard d ON (r.position IS NULL OR d.position = r.position)
       AND (r.max_price IS NULL OR d.price <= r.max_price) AND (r.min_form IS NULL OR d.form >= r.min_form)
       AND (r.team IS NULL OR strpos(lower(d.team_name), lower(r.team)) > 0)) x
WHERE rank <= lim""", "v_dashboard")


@query("text_search")
def _(c: Context):
    """Free-text filter over name, team and position."""
    return lookup.text_search(c.dashboard_shared, "nation_2", ["web_name", "team_name", "position"]) \
        .select("player_id", "web_name", "team_name")


oracle("text_search", """
SELECT player_id, web_name, team_name FROM v_dashboard
WHERE coalesce(strpos(lower(web_name), 'nation_2') > 0, false)
   OR coalesce(strpos(lower(team_name), 'nation_2') > 0, false)
   OR coalesce(strpos(lower(position), 'nation_2') > 0, false)""", "v_dashboard")

# --- J11 ------------------------------------------------------------------------------


def knn_queries(c: Context):
    """Query vectors: the lowest-id vector of every label (one per class)."""
    e = c.t.embeddings
    q = e.groupBy("label").agg(F.min_by("vec_id", "vec_id").alias("vec_id"))
    return q.join(e.select("vec_id", "embedding"), "vec_id", "inner")


@query("knn_exact")
def _(c: Context):
    """J11 exact: 5 nearest neighbours by cosine per query vector."""
    return lookup.knn_exact(knn_queries(c), c.t.embeddings, 5, "vec_id", "vec_id", "embedding")


_UNIT = ("list_transform(CAST({e} AS DOUBLE[]), lambda x: x / sqrt(list_reduce(list_transform(CAST({e} AS DOUBLE[]), "
         "lambda y: y * y), lambda a, b: a + b)))")
_DOT = "list_reduce(list_transform(list_zip({a}, {b}), lambda p: p[1] * p[2]), lambda s, t: s + t)"

view("v_knn_q", (), f"""
SELECT e.vec_id AS qid, {_UNIT.format(e='e.embedding')} AS qu
FROM embeddings e JOIN (SELECT label, min(vec_id) AS vec_id FROM embeddings GROUP BY label) m
  ON e.vec_id = m.vec_id""")

view("v_knn_b", (), f"""SELECT vec_id AS bid, {_UNIT.format(e='embedding')} AS bu FROM embeddings""")

_KNN_SQL = f"""
SELECT query_id, rank, vec_id, similarity FROM (
  SELECT q.qid AS query_id, b.bid AS vec_id, round_even({_DOT.format(a='q.qu', b='b.bu')}, 6) AS similarity,
         CAST(row_number() OVER (PARTITION BY q.qid ORDER BY round_even({_DOT.format(a='q.qu', b='b.bu')}, 6) DESC,
                                 b.bid) AS INTEGER) AS rank
  FROM v_knn_q q JOIN v_knn_b b ON q.qid <> b.bid) x
WHERE rank <= 5"""
oracle("knn_exact", _KNN_SQL, "v_knn_q", "v_knn_b")
oracle("knn_cells", _KNN_SQL, "v_knn_q", "v_knn_b")


@query("knn_cells")
def _(c: Context):
    """J11 by cells with radius bounds: the same neighbours as knn_exact."""
    return lookup.knn_cells(knn_queries(c), c.t.embeddings, 5, "vec_id", "vec_id", "embedding", n_cells=16)


# --- S14 S16 --------------------------------------------------------------------------------


@query("vector_upsert")
def _(c: Context):
    """A batch re-embedding label 0 (negated vectors) and adding copies
    of label 1 under new ids, upserted by vec_id."""
    e = c.t.embeddings.select("vec_id", "label", "embedding", F.lit("old").alias("origin"))
    upd = e.where(F.col("label") == 0).select("vec_id", "label",
                                              F.transform("embedding", lambda x: -x).alias("embedding"),
                                              F.lit("new").alias("origin"))
    add = e.where(F.col("label") == 1).select((F.col("vec_id") + 1000000).alias("vec_id"), "label", "embedding",
                                              F.lit("new").alias("origin"))
    u = lookup.keyed_upsert(e, upd.unionByName(add), "vec_id")
    return u.select("vec_id", "label", "origin", F.get("embedding", 0).cast("double").alias("e0"))


oracle("vector_upsert", """
SELECT vec_id, label, CASE WHEN label = 0 THEN 'new' ELSE 'old' END AS origin,
       CAST(CASE WHEN label = 0 THEN -embedding[1] ELSE embedding[1] END AS DOUBLE) AS e0 FROM embeddings
UNION ALL
SELECT vec_id + 1000000, label, 'new', CAST(embedding[1] AS DOUBLE) FROM embeddings WHERE label = 1""")


@query("vector_parse")
def _(c: Context):
    """Vectors stored as text ('[..]' or '') parsed back to arrays."""
    e = c.t.embeddings
    txt = F.when(F.col("vec_id") % 50 == 0, F.lit("")).otherwise(F.to_json("embedding"))
    p = e.select("vec_id", lookup.parse_vector(txt).alias("v"))
    return p.select("vec_id", F.size("v").alias("dim"), F.get("v", 0).cast("double").alias("e0"))


oracle("vector_parse", """
SELECT vec_id, CAST(CASE WHEN vec_id % 50 = 0 THEN 0 ELSE len(embedding) END AS INTEGER) AS dim,
       CAST(CASE WHEN vec_id % 50 = 0 THEN NULL ELSE embedding[1] END AS DOUBLE) AS e0 FROM embeddings""")

# --- W11 J10 S17 A33 ----------------------------------------------------------------------

MUST_INCLUDE = "0000001"


def _pool(c: Context):
    n = c.t.nation.select(F.col("n_nationkey").cast("int").alias("team_id"), F.col("n_regionkey").alias("league_id"))
    return c.dashboard_shared.join(n, "team_id", "inner")


@query("canned_squad")
def _(c: Context):
    """A 15-player squad per league (region) with a forced name."""
    return lookup.canned_squads(_pool(c), "league_id", MUST_INCLUDE)


view("v_pool", ("v_dashboard",), """
SELECT d.*, n.n_regionkey AS league_id FROM v_dashboard d JOIN nation n ON d.team_id = n.n_nationkey""")
view("v_forced", ("v_pool",), f"""
SELECT league_id, arg_max(player_id, row(total_points, -src_pos)) AS fid,
       arg_max(position, row(total_points, -src_pos)) AS fpos
FROM v_pool WHERE strpos(lower(web_name), '{MUST_INCLUDE}') > 0 GROUP BY league_id""")
view("v_sel", ("v_pool", "v_forced"), """
SELECT * FROM (
  SELECT league_id, player_id, position,
         CASE WHEN position = fpos AND r >= 2 THEN r + 1 ELSE r END AS idx FROM (
    SELECT p.league_id, p.player_id, p.position, f.fpos,
           row_number() OVER (PARTITION BY p.league_id, p.position ORDER BY p.total_points DESC, p.src_pos) AS r
    FROM v_pool p LEFT JOIN v_forced f ON p.league_id = f.league_id
    WHERE f.fid IS NULL OR p.player_id <> f.fid) x
  UNION ALL
  SELECT league_id, fid, fpos, 2 FROM v_forced) y
WHERE position IN ('GKP', 'DEF', 'MID', 'FWD')
  AND idx <= CASE position WHEN 'GKP' THEN 2 WHEN 'DEF' THEN 5 WHEN 'MID' THEN 5 ELSE 3 END""")
view("v_bad", ("v_sel", "v_pool"), """
SELECT l.league_id FROM (SELECT DISTINCT league_id FROM v_pool) l
LEFT JOIN (SELECT league_id, count(*) AS n FROM (
             SELECT league_id, position, count(*) AS c FROM v_sel GROUP BY league_id, position) z
           WHERE c = CASE position WHEN 'GKP' THEN 2 WHEN 'DEF' THEN 5 WHEN 'MID' THEN 5 ELSE 3 END
           GROUP BY league_id) f ON l.league_id = f.league_id
WHERE coalesce(f.n, 0) < 4""")

oracle("canned_squad", """
SELECT league_id,
       CAST(row_number() OVER (PARTITION BY league_id ORDER BY
            idx > CASE position WHEN 'GKP' THEN 1 WHEN 'DEF' THEN 4 WHEN 'MID' THEN 4 ELSE 2 END,
            CASE position WHEN 'GKP' THEN 1 WHEN 'DEF' THEN 2 WHEN 'MID' THEN 3 ELSE 4 END, idx) AS INTEGER) AS slot,
       player_id, position,
       CASE WHEN idx > CASE position WHEN 'GKP' THEN 1 WHEN 'DEF' THEN 4 WHEN 'MID' THEN 4 ELSE 2 END THEN 0
            WHEN position = 'MID' AND idx = 1 THEN 2 ELSE 1 END AS multiplier,
       position = 'MID' AND idx = 1 AS is_captain, position = 'FWD' AND idx = 1 AS is_vice_captain,
       CAST(NULL AS VARCHAR) AS reason
FROM v_sel WHERE league_id NOT IN (SELECT league_id FROM v_bad)
UNION ALL
SELECT league_id, NULL, NULL, NULL, NULL, NULL, NULL, 'too sparse for a 2/5/5/3 squad' FROM v_bad""",
       "v_sel", "v_bad")


def squads(c: Context):
    """One squad per order: its line items are the picks (JSON, as landed)."""
    li = c.t.lineitem
    pk = F.struct((F.col("l_suppkey") * 15 + F.col("l_linenumber")).alias("element"),
                  (F.col("l_linenumber") + (F.col("l_partkey") % 3) * 5).cast("int").alias("position"),
                  F.when(F.col("l_linenumber") == 1, 2).otherwise(1).alias("multiplier"),
                  (F.col("l_linenumber") == 1).alias("is_captain"),
                  (F.col("l_linenumber") == 2).alias("is_vice_captain"),
                  (F.col("l_partkey") % 4 + 1).cast("int").alias("element_type"))
    return li.groupBy(F.col("l_orderkey").alias("squad_id")).agg(F.to_json(F.collect_list(pk)).alias("picks_json"))


def _squad_players(c: Context):
    p = c.players.join(c.teams, "team_id", "left")
    return p.select("player_id", "web_name", "team_name", F.bround(F.col("now_cost") / 10, 1).alias("price"))


@query("squad_enrich")
def _(c: Context):
    """Picks parsed, exploded and enriched; unknown -> '#id'."""
    return lookup.enrich_picks(squads(c), _squad_players(c))


view("v_picks_long", ("v_players", "v_teams"), """
SELECT l.l_orderkey AS squad_id, CAST(l.l_linenumber + (l.l_partkey % 3) * 5 AS INTEGER) AS position,
       l.l_suppkey * 15 + l.l_linenumber AS element,
       coalesce(p.web_name, '#' || CAST(l.l_suppkey * 15 + l.l_linenumber AS VARCHAR)) AS web_name,
       coalesce(t.team_name, 'Unknown') AS team_name,
       coalesce(round_even(CAST(p.now_cost AS DOUBLE) / 10.0::DOUBLE, 1), 0.0::DOUBLE) AS price,
       CASE WHEN l.l_linenumber = 1 THEN 2 ELSE 1 END AS multiplier,
       l.l_linenumber = 1 AS is_captain, l.l_linenumber = 2 AS is_vice_captain
FROM lineitem l LEFT JOIN v_players p ON l.l_suppkey * 15 + l.l_linenumber = p.player_id
LEFT JOIN v_teams t ON p.team_id = t.team_id""")

oracle("squad_enrich", "SELECT * FROM v_picks_long", "v_picks_long")


@query("squad_split")
def _(c: Context):
    """Starters / bench / captain / vice per squad."""
    return lookup.split_squad(lookup.enrich_picks(squads(c), _squad_players(c)))


_ORD = "ORDER BY position, web_name, is_captain, is_vice_captain"
oracle("squad_split", f"""
SELECT squad_id,
       coalesce(string_agg(web_name, ', ' {_ORD}) FILTER (WHERE position <= 11), '') AS starters,
       coalesce(string_agg(web_name, ', ' {_ORD}) FILTER (WHERE position > 11), '') AS bench,
       coalesce(string_agg(web_name, ', ' {_ORD}) FILTER (WHERE is_captain), '') AS captain,
       coalesce(string_agg(web_name, ', ' {_ORD}) FILTER (WHERE is_vice_captain), '') AS vice_captain
FROM v_picks_long GROUP BY squad_id""", "v_picks_long")


# --- S17: whole squad documents ----------------------------------------------------------------------

@query("squad_totals")
def _(c: Context):
    """Squad documents read into picks and totals; the totals, with the
    picks' value held against the document's."""
    k = F.col("squad_id")
    priced = c.t.lineitem.select(
        F.col("l_orderkey").alias("squad_id"), (F.col("l_suppkey") * 15 + F.col("l_linenumber")).alias("player_id")) \
        .join(c.players.select("player_id", "now_cost"), "player_id").groupBy("squad_id").agg(
            F.sum("now_cost").alias("cost"))
    docs = squads(c).join(priced, "squad_id", "left")
    bank = (k % 50).cast("int")
    history = F.struct(bank.alias("bank"), (F.coalesce("cost", F.lit(0)) + bank + F.when(k % 9 == 0, 1).otherwise(0))
                       .cast("int").alias("value"), (k % 900).cast("int").alias("total_points"),
                       F.when(k % 8 != 0, k * 3).alias("overall_rank"))
    text = F.concat(
        F.lit('{"picks":'), F.when(k % 21 == 0, "[]").otherwise(F.col("picks_json")),
        F.when(k % 11 == 0, "").otherwise(F.concat(F.lit(',"entry_history":'), F.to_json(history))),
        F.when(k % 5 == 0, ',"active_chip":"bboost"').otherwise(""), F.lit("}"))
    docs = docs.select("squad_id", F.when(k % 31 == 0, "<html>").otherwise(text).alias("squad_json"))
    return lookup.squad_documents(docs, _squad_players(c))[1]


oracle("squad_totals", """
SELECT * FROM (WITH li AS (
  SELECT l_orderkey AS k, count(*) AS n, count(*) - count(p.player_id) AS unknown, sum(p.now_cost) AS cost,
         sum(round_even(p.now_cost / 10.0::DOUBLE, 1) * 10) AS tenths, count(t.team_id) AS teams
  FROM lineitem l LEFT JOIN v_players p ON l.l_suppkey * 15 + l.l_linenumber = p.player_id
  LEFT JOIN v_teams t ON p.team_id = t.team_id GROUP BY l_orderkey),
s AS (SELECT *, k % 31 = 0 AS bad, k % 21 = 0 AS none, k % 11 = 0 AS bare, k % 50 AS b,
             coalesce(cost, 0) + k % 50 + CASE WHEN k % 9 = 0 THEN 1 ELSE 0 END AS v FROM li)
SELECT k AS squad_id, CASE WHEN bad THEN 'unreadable' WHEN none THEN 'not found' ELSE 'ok' END AS status,
       CAST(CASE WHEN bad OR none THEN 0 ELSE n END AS INTEGER) AS n_picks,
       CASE WHEN bad OR bare THEN 0.0::DOUBLE ELSE b / 10.0::DOUBLE END AS bank,
       CASE WHEN bad OR bare THEN 0.0::DOUBLE ELSE v / 10.0::DOUBLE END AS total_value,
       CASE WHEN NOT bad AND k % 5 = 0 THEN 'bboost' END AS active_chip,
       CASE WHEN NOT bad AND NOT bare AND k % 8 <> 0 THEN k * 3 END AS overall_rank,
       CAST(CASE WHEN bad OR bare THEN 0 ELSE k % 900 END AS INTEGER) AS total_points,
       CASE WHEN NOT bad AND NOT none AND NOT bare AND n = teams THEN tenths + b = v END AS value_ok
FROM s)""", "v_players", "v_teams")
