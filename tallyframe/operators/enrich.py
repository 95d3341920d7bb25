"""Enrichment as data: news relevance, entity<->article containment, merge of
enricher outputs, output contracts, pass rates, request batching, profile
text, and the injected-function boundaries (enricher / embedder)."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.operators.ranking import position_within_key
from tallyframe.session import scratch_path

# Premier League relevance keywords for the news filter.
PL_KEYWORDS = [
    "premier league", "epl", "fpl", "arsenal", "aston villa", "bournemouth", "brentford",
    "brighton", "chelsea", "crystal palace", "everton", "fulham", "ipswich", "leicester",
    "liverpool", "manchester city", "manchester united", "man city", "man utd", "newcastle",
    "nottingham forest", "southampton", "tottenham", "spurs", "west ham", "wolves", "wolverhampton",
]

_IN, _OUT = r"[\p{L}\p{N}]", r"[^\p{L}\p{N}]"
_WORD = _IN + "+"       # a word = a maximal run of letters/digits (lossless word blocking)
RUN_WORDS = 4           # inner words of a name that are looked for together, at most
SIEVE = 1 << 20         # buckets of keys: bounds the broadcast of ``_sifted``


def keyword_pattern(keywords) -> str:
    """One escaped alternation: a single ``rlike`` instead of 27 ``contains``."""
    return "|".join(f"\\Q{k}\\E" for k in keywords)


def relevant_articles(articles: DataFrame, text_cols, date_col: str, published_col: str,
                      as_of: str, window_days: int, keywords=PL_KEYWORDS) -> DataFrame:
    """S5+S6: articles in the rolling window ``(as_of - window_days, as_of]``
    whose published date equals the partition date and whose lower-cased
    text contains any keyword.  The date range prunes partitions; the
    keyword test is one regex over the concatenated text."""
    text = F.lower(F.concat_ws(" ", *[F.col(c) for c in text_cols]))
    return articles.where(
        (F.col(date_col) > F.date_sub(F.lit(as_of).cast("date"), window_days))
        & (F.col(date_col) <= F.lit(as_of).cast("date"))
        & (F.col(published_col) == F.col(date_col))
        & text.rlike(keyword_pattern(keywords)))


# --- J5 / J9 containment -----------------------------------------------------------

def _grams(col, n: int):
    """Distinct character n-grams of a string column (JVM higher-order fns)."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(col) - (n - 1), F.lit(1))),
                                        lambda i: F.substring(col, i, n)))


def _sifted(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """``df`` without most rows whose ``key`` is not in ``wanted``: the buckets
    of the wanted keys, SIEVE at most, are broadcast.  Some other rows stay; the
    join that follows drops them, but they alone take part in its exchange."""
    bucket = F.pmod(F.xxhash64(key), F.lit(SIEVE)).alias("_b")
    return df.select("*", bucket).join(F.broadcast(wanted.select(bucket).distinct()), "_b", "left_semi").drop("_b")


def _runs(df: DataFrame, words: str, n: int) -> DataFrame:
    """Rows of ``df`` with ``_g``, the digest of ``n`` words that follow each
    other in the array ``words``: one row for each place."""
    at = df.select("*", F.posexplode(words).alias("_p", "_w")).where(F.col("_p") + n <= F.size(words))
    return at.withColumn("_g", F.xxhash64("_w", *[F.get(words, F.col("_p") + i) for i in range(1, n)])) \
        .drop("_p", "_w", words)


def _by_grams(needles: DataFrame, hay: DataFrame, k: int) -> DataFrame:
    """Pairs (``_key``, ``_nid``, ``_name``) whose ``_h`` contains ``_s``, by the
    rarest k-gram of ``_s`` (all of it when shorter: only the lengths present
    among the needles are made)."""
    out = None
    n = F.length("_s")
    for m in [r[0] for r in needles.select(F.least(n, F.lit(k))).distinct().collect()]:  # at most k lengths
        some = needles.where(F.least(n, F.lit(k)) == m)
        ng = some.select("_nid", "_name", "_s", F.explode(_grams(F.col("_s"), m)).alias("_g"))
        grams = hay.select("_key", "_h", F.explode(_grams(F.col("_h"), m)).alias("_g")) \
            .join(ng.select("_g").distinct(), "_g", "left_semi")
        df = grams.groupBy("_g").agg(F.count(F.lit(1)).alias("_df"))
        pick = ng.join(df, "_g").groupBy("_nid", "_name", "_s").agg(F.min_by("_g", F.struct("_df", "_g")).alias("_g"))
        found = grams.join(pick, "_g").where(F.col("_h").contains(F.col("_s"))).select("_key", "_nid", "_name")
        out = found if out is None else out.unionByName(found)
    return out


def containment_matches(names: DataFrame, docs: DataFrame, entity: str, name: str, text: Column, k: int = 3,
                        freq_sample: float = 0.05) -> DataFrame:
    """Rows of ``docs`` (columns of ``docs`` plus ``_entity``) whose text
    contains a name of the entity, ignoring case: one row per entity and row of
    ``docs``, whichever and however many of its names occur (OR).  Lossless
    blocking, then exact verification; one way for any number of names, any
    ids (null and repeated ones too), batch or micro-batch.

    Names of three words and more meet the texts by a run of inner words (up
    to RUN_WORDS), of two by what stands around their separator, of one by the
    words that hold it, and others by a character gram; each names ONE key that
    every text with the name has, the rarest where there is a choice.

    Candidates carry a digest of the whole row in place of its id: rows without
    an id spread like any other, and a digest that two rows share costs a
    comparison, not a result, since every row is verified by its own text.
    """
    nm = names.select(F.col(entity).alias("_nid"), F.lower(F.col(name)).alias("_name")) \
              .where(F.length("_name") > 0)
    # The names are read by every branch below: made once, in shared storage.
    spark, path = docs.sparkSession, scratch_path(docs.sparkSession, "names")
    nm.write.parquet(path)
    nm = spark.read.schema(nm.schema).parquet(path)
    dl = docs.select("*", F.lower(text).alias("_text"))
    dl = dl.withColumn("_did", F.xxhash64(*[F.col(f"`{c}`") for c in dl.columns]))
    # The texts are spread over all tasks, whatever the files' splits, for the
    # tokenising and the verification join.
    dl = dl.repartition("_did")
    # (1) Word blocking.  Words strictly inside a name (not its first or last
    # token) are bounded by separators inside the name, so wherever the name
    # occurs they are complete words of the text too, in the same order:
    # lossless.  Up to RUN_WORDS of them are looked for together: a word that
    # many texts have says little about a name of many words.
    toks = F.regexp_extract_all(F.col("_name"), F.lit(_WORD), 0)
    nt = nm.select("_nid", "_name", toks.alias("_t"))
    inner = nt.where(F.size("_t") >= 3).select("_nid", "_name", F.slice("_t", 2, F.size("_t") - 2).alias("_i"))
    run = F.least(F.size("_i"), F.lit(RUN_WORDS))
    runs = [r[0] for r in sorted(inner.select(run).distinct().collect())]  # at most RUN_WORDS lengths
    # (2) needs what stands around a separator: up to k characters of the words
    # on either side.  Both lists are made once for each text, and written: the
    # joins below read them, not the texts.
    tail = f"(?:{_IN}{{{k}}}|(?<!{_IN}){_IN}{{1,{max(k - 1, 1)}}})"
    path = scratch_path(spark, "words")
    dl.select("_did", F.regexp_extract_all(F.col("_text"), F.lit(_WORD), 0).alias("_words"),
              F.array_distinct(F.regexp_extract_all(
                  F.col("_text"), F.lit(f"(?=({tail}{_OUT}+{_IN}{{1,{k}}}))"), 1)).alias("_around")) \
        .write.option("compression", "zstd").parquet(path)
    parts = spark.read.schema("_did long, _words array<string>, _around array<string>").parquet(path)
    dwords = parts.select("_did", F.explode(F.array_distinct("_words")).alias("_g"))

    def stored(df: DataFrame, name: str) -> DataFrame:
        """Names by key, written first: the planner then knows their size, which
        spares the texts' words an exchange if the list is short enough."""
        at = scratch_path(spark, name)
        df.write.parquet(at)
        return spark.read.schema(df.schema).parquet(at)
    cands = [nm.select(F.lit(0).cast("long").alias("_did"), "_nid", "_name").limit(0)]

    def add(df: DataFrame) -> None:
        cands.append(df.select("_did", "_nid", "_name"))
    # A run's rarity only steers the choice (any inner run is lossless), so
    # it is estimated on a fixed-seed sample of the texts.
    for n in runs:
        keys = _runs(inner.where(run == n), "_i", n).distinct()
        freq = _sifted(_runs(parts.select("_did", "_words").sample(fraction=freq_sample, seed=17), "_words", n), "_g", keys) \
            .distinct().groupBy("_g").agg(F.count(F.lit(1)).alias("_df"))
        pick = (keys.join(freq, "_g", "left")
                    .groupBy("_nid", "_name")
                    .agg(F.min_by("_g", F.struct(F.coalesce(F.col("_df"), F.lit(0)), F.col("_g"))).alias("_g")))
        pick = stored(pick, "inner-words")
        add(_sifted(_runs(parts.select("_did", "_words"), "_words", n), "_g", pick).distinct().join(pick, "_g"))
    # (2) Two words: where "ab cd" occurs, a word of the text ends in "ab" and
    # the next one, behind the same separators, begins with "cd".  The key is
    # what stands around the separators, up to k characters on either side; the
    # few pairs of side lengths present among the names are looked for in the
    # vocabulary of what stands there.
    two = nt.where(F.size("_t") == 2).select(
        "_nid", "_name", F.least(F.length(F.get("_t", 0)), F.lit(k)).alias("_i"),
        F.least(F.length(F.get("_t", 1)), F.lit(k)).alias("_j"))
    lengths = [tuple(r) for r in sorted(two.select("_i", "_j").distinct().collect())]  # at most k * k pairs
    if lengths:
        key_of = lambda c, i, j: F.regexp_extract(c, f"({_IN}{{{i}}}{_OUT}+{_IN}{{{j}}})", 1)
        want = two.select("_nid", "_name", F.coalesce(*[
            F.when((F.col("_i") == i) & (F.col("_j") == j), key_of("_name", i, j)) for i, j in lengths]).alias("_g"))
        around = parts.select("_did", F.explode("_around").alias("_a"))
        hold = around.select("_a").distinct().select("_a", F.explode(F.array(
            *[key_of("_a", i, j) for i, j in lengths])).alias("_g")).where("_g <> ''").join(want, "_g")
        hold = stored(hold.select("_a", "_nid", "_name").distinct(), "around")
        add(_sifted(around, "_a", hold).join(hold, "_a"))
    # (3) One word: it lies inside a word of the text.  Words that hold it are
    # found once in the vocabulary, which is much smaller than the texts.  Where
    # the name has a separator before (behind) its word, the text has it too:
    # its word begins (ends) with the name's.
    one = nt.where(F.size("_t") == 1).select("_nid", "_name", F.get("_t", 0).alias("_s"))
    if not one.isEmpty():
        hold = _by_grams(one, dwords.select(F.col("_g").alias("_key"), F.col("_g").alias("_h")).distinct(), k)
        word, key, name_ = F.regexp_extract("_name", f"({_WORD})", 1), F.col("_key"), F.col("_name")
        hold = hold.where((name_.startswith(word) | key.startswith(word)) & (name_.endswith(word) | key.endswith(word)))
        hold = stored(hold.withColumnRenamed("_key", "_g"), "one-word")
        add(_sifted(dwords, "_g", hold).join(hold, "_g"))
    # (4) No word at all (separators only): character grams of the texts.
    none = nt.where(F.size("_t") == 0).select("_nid", "_name", F.col("_name").alias("_s"))
    if not none.isEmpty():
        add(_by_grams(none, dl.select(F.col("_did").alias("_key"), F.col("_text").alias("_h")), k)
            .withColumnRenamed("_key", "_did"))
    # (5) Exact verification: a row and an entity meet once, with the few
    # names of the entity that are candidates there.
    met = reduce(DataFrame.unionByName, cands).groupBy("_did", "_nid").agg(F.collect_set("_name").alias("_names"))
    v = met.join(dl, "_did", "inner").where(F.exists("_names", lambda n: F.col("_text").contains(n)))
    return v.select(*[F.col(f"`{c}`") for c in docs.columns], F.col("_nid").alias("_entity"))


def containment_join(names: DataFrame, docs: DataFrame, name_id: str, name_col: str,
                     doc_id: str, text_col: str, k: int = 3, freq_sample: float = 0.05) -> DataFrame:
    """Distinct pairs (name id, document id) where the text contains the
    name; see ``containment_matches``."""
    d = docs.select(F.col(doc_id).alias("_doc"), F.col(text_col).alias("_body"))
    m = containment_matches(names, d, name_id, name_col, F.col("_body"), k, freq_sample)
    return m.select(F.col("_entity").alias(name_id), F.col("_doc").alias(doc_id)).distinct()


def numbered(df: DataFrame, out: str = "_row") -> DataFrame:
    """``df`` with a number for every row, fixed by writing it once to the
    shared folder: rows without an id, or with a repeated one, stay apart."""
    path = scratch_path(df.sparkSession, "numbered")
    t = df.withColumn(out, F.monotonically_increasing_id())
    t.write.parquet(path)
    return df.sparkSession.read.schema(t.schema).parquet(path)


def entity_articles(entities: DataFrame, articles: DataFrame, short: str, first: str, second: str,
                    title: str = "title", summary: str = "summary") -> tuple[DataFrame, DataFrame]:
    """Articles that mention an entity by its short name OR by its first
    and second name, in ``title + " " + summary``, ignoring case.

    Returns the numbered entities (``_row``) and the matches in long form: the
    articles' columns with ``_entity`` = ``_row``, one row per entity and
    article however many of its names occur.  A missing part counts as empty;
    a name of blanks alone names nobody.
    """
    ent = numbered(entities)
    part = lambda c: F.coalesce(F.col(c), F.lit(""))
    both = F.concat(part(first), F.lit(" "), part(second))
    names = ent.select("_row", F.explode(F.array_distinct(F.array(F.lower(part(short)), F.lower(both)))).alias("_n")) \
        .where(F.trim("_n") != "")
    text = F.concat(part(title), F.lit(" "), part(summary))
    return ent, containment_matches(names, articles, "_row", "_n", text)


def attach_articles(entities: DataFrame, matches: DataFrame, order, fields) -> DataFrame:
    """Every entity with ``news_articles``, the array of its articles'
    ``fields`` in ``order`` (empty when nothing mentions it).  The array is the
    product's output; for an entity that a large share of all articles
    mentions, use the long form that it is made from."""
    row = F.struct(*order, F.struct(*fields).alias("_article"))
    lists = matches.groupBy("_entity").agg(F.array_sort(F.collect_list(row)).alias("_l"))
    article = entities.join(lists, F.col("_row") == F.col("_entity"), "left")
    found = F.transform("_l", lambda x: x["_article"])
    return article.withColumn("news_articles", F.coalesce(found, F.filter(F.array(F.struct(
        *[F.lit(None).cast(matches.schema[f].dataType).alias(f) for f in fields])), lambda x: F.lit(False)))) \
        .drop("_l", "_entity", "_row")


# --- J7 merge, Q7 contracts, Q8 pass rate ------------------------------------------

def merge_enrichments(base: DataFrame, results: DataFrame, key: str, enrichers, fields: dict) -> DataFrame:
    """Long-form enricher outputs ``(key, enricher, enrichment struct)``
    merged onto ``base`` with prefixed columns.  Null results are ignored,
    a missing enricher yields nulls; the last record per (key, enricher)
    wins (``max_by`` on ``seq``).  One pivot aggregate + one left join."""
    r = results.where(F.col("enrichment").isNotNull())
    p = r.groupBy(key).pivot("enricher", list(enrichers)).agg(F.max_by("enrichment", "seq"))
    cols = []
    for e in enrichers:
        for f in fields[e]:
            cols.append(F.col(e).getField(f).alias(f"{e}_{f}"))
    p = p.select(key, *cols)
    return base.join(p, key, "left")


def validate_output(json_col, schema: T.StructType, checks: Callable[[F.Column], F.Column]) -> F.Column:
    """Q7: parse an enricher's JSON output; unknown keys, type errors or
    failed field checks null the whole item (the product's contract)."""
    parsed = F.from_json(json_col, schema)
    keys = F.map_keys(F.from_json(json_col, "map<string,string>"))
    allowed = F.array(*[F.lit(f.name) for f in schema.fields])
    no_extra = F.size(F.array_except(keys, allowed)) == 0
    ok = parsed.isNotNull() & no_extra & checks(parsed)
    return F.when(F.coalesce(ok, F.lit(False)), parsed)


# Output contracts of two of the four enrichers.
INJURY_SCHEMA = T.StructType([
    T.StructField("risk_score", T.IntegerType()), T.StructField("reasoning", T.StringType()),
    T.StructField("injury_type", T.StringType()), T.StructField("sources", T.ArrayType(T.StringType())),
])


def injury_checks(p: F.Column) -> F.Column:
    r = p.getField("risk_score")
    return r.isNotNull() & (r >= 0) & (r <= 10) & (F.length(p.getField("reasoning")) >= 1)


SUMMARY_SCHEMA = T.StructType([
    T.StructField("summary", T.StringType()), T.StructField("form_trend", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
])


def summary_checks(p: F.Column) -> F.Column:
    c = p.getField("confidence")
    return ((F.length(p.getField("summary")) >= 20)
            & p.getField("form_trend").isin("improving", "stable", "declining")
            & c.isNotNull() & (c >= 0.0) & (c <= 1.0))


def pass_rate(checked: DataFrame, group: str, ok_col: str) -> DataFrame:
    """Q8: valid / (valid + invalid), rounded to 4 dp, per enricher."""
    return checked.groupBy(group).agg(
        F.count_if(F.col(ok_col)).alias("valid"),
        F.count_if(~F.col(ok_col)).alias("invalid"),
        F.bround(F.avg(F.col(ok_col).cast("double")), 4).alias("pass_rate"))


# --- P24 P25 W10 ----------------------------------------------------------------------

def prune_fields(df: DataFrame, relevant) -> DataFrame:
    """Keep only the fields a consumer needs (existing ∩ relevant);
    Catalyst prunes the rest from the scan."""
    return df.select(*[c for c in df.columns if c in set(relevant)])


def assign_batches(df: DataFrame, key_cols, order_cols, size: int) -> DataFrame:
    """Consecutive chunks of ``size`` within each key, deterministic ids
    ``floor(pos / size)``.  The position comes from a range-partitioned
    rank, so a hot key is split across tasks."""
    p = position_within_key(df, key_cols, order_cols, out="_pos")
    return p.select("*", F.floor(F.col("_pos") / size).cast("bigint").alias("batch_no"),
                    ((F.col("_pos") % size) + 1).cast("int").alias("item_no")).drop("_pos")


def batch_payloads(batched: DataFrame, key_cols, line_col: str) -> DataFrame:
    """P25: ``I{n}: {item}`` lines of each batch joined in item order (a
    batch holds at most ``size`` items, so the collect is bounded)."""
    lines = batched.select(*key_cols, "batch_no", "item_no",
                           F.concat(F.lit("I"), F.col("item_no").cast("string"), F.lit(": "), F.col(line_col))
                           .alias("_line"))
    g = lines.groupBy(*key_cols, "batch_no").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.array_sort(F.collect_list(F.struct("item_no", "_line"))).alias("_l"))
    return g.select(*key_cols, "batch_no", "n_items", F.array_join(F.col("_l").getField("_line"), "\n").alias("payload"))


# --- P26 profile text -------------------------------------------------------------------

# Fixed value: the profile text, line by line.
PROFILE_TEXT = (
    "%s (%s, %s). Price: £%sm. Form: %s.\n"
    "Points: %s. Goals: %s, Assists: %s.\n"
    "Summary: %s\n"
    "Form trend: %s. Injury risk: %s/10.\n"
    "Fixture difficulty (next 3): %s/5."
)


def profile_text(df: DataFrame) -> F.Column:
    """Five-line profile text; a missing name is "Unknown", a missing or
    empty summary "No summary available", anything else missing "N/A"."""
    def known(c, default="N/A"):
        return F.coalesce(F.col(c).cast("string"), F.lit(default))

    def filled(c, default):
        return F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(default))
    return F.format_string(
        PROFILE_TEXT, known("web_name", "Unknown"), known("position"), known("team_name"), known("price"),
        known("form"), known("total_points"), known("goals_scored"), known("assists"),
        filled("llm_summary", "No summary available"), filled("form_trend", "N/A"), known("injury_risk"),
        known("fdr_next_3"))


# --- X2 / X3 injected functions ------------------------------------------------------------

def enrich(df: DataFrame, fn: Callable[[list[dict]], list[dict]], fields, batch_size: int,
           out_schema: T.StructType, key: str) -> DataFrame:
    """Call an injected batch function on consecutive chunks of each
    partition (``mapInPandas``).  A batch that raises or returns the wrong
    number of items yields nulls for the whole batch."""
    fields = list(fields)
    names = [f.name for f in out_schema.fields]

    def run(it):
        for pdf in it:
            recs = pdf[fields].to_dict("records")
            outs: list = []
            for i in range(0, len(recs), batch_size):
                chunk = recs[i:i + batch_size]
                try:
                    res = fn(chunk)
                    if not isinstance(res, list) or len(res) != len(chunk):
                        res = [None] * len(chunk)
                except Exception:  # noqa: BLE001 - the product's per-batch failure policy
                    res = [None] * len(chunk)
                outs.extend(res)
            rows = [{n: (o or {}).get(n) for n in names} for o in outs]
            out = pd.DataFrame(rows, columns=names)
            out.insert(0, key, pdf[key].values)
            out["enrichment_json"] = [None if o is None else json.dumps(o, sort_keys=True) for o in outs]
            yield out

    schema = T.StructType([df.schema[key]] + list(out_schema.fields)
                          + [T.StructField("enrichment_json", T.StringType())])
    return df.select(*dict.fromkeys([key] + fields)).mapInPandas(run, schema)


def embed(df: DataFrame, text_col: str, fn: Callable[[list[str]], list[list[float]]], dim: int) -> DataFrame:
    """An injected embedding function over Arrow batches (iterator
    pandas UDF: the model is loaded once per task); vectors whose length is
    not ``dim`` become null (the Q check on length)."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def _emb(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            vecs = fn(s.tolist())
            yield pd.Series([v if v is not None and len(v) == dim else None for v in vecs])

    return df.select("*", _emb(F.col(text_col)).alias("embedding"))
