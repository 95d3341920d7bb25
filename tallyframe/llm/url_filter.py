"""URL filter by the likelihood ratio of two character language models.

Hand rules come first: a rule (host and path, such as ``org/fr/``) fits its
host and all subdomains when the URL's path starts with the rule's path; the
longest one decides.  URLs without a rule are judged by two smoothed
variable-order Markov models, one of accepted and one of rejected URLs (those
that rules allow or block).  A character's probability after the last
``order`` characters is interpolated down to shorter contexts,

    P(c | ctx) = (n(ctx c) + t(ctx) * P(c | shorter ctx)) / (n(ctx) + t(ctx)),

t(ctx) being the number of different characters seen after the context, down
to a uniform distribution.  A URL's figure is the mean log-ratio of the two
models over its characters, so long URLs are not favoured.  The cut is
calibrated on a fold of the judged URLs that the models have not seen (one at
least of each group that has two different URLs): it lies
between the two groups' means, at the same number of standard deviations from
both.

All counts cover all judged URLs and are DataFrame aggregations; a model has a
row for each context and character that occurs, a number that is bounded by
the alphabet (``ALPHABET``; every other character counts as one more) to the
power of order + 1 and mostly far smaller.  URLs meet the log-ratios in a join
of exchanged rows that adaptive execution may split at hot contexts.

Defined cases: a null URL or one without ``://`` has an empty host and path,
no rule, and is judged as the empty text; without URLs of both groups nothing
is blocked but by rule; repeated rows get the same verdict; an empty table
gives an empty result; a null ``page_id`` is carried through; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.session import scratch_path

ALPHABET = "abcdefghijklmnopqrstuvwxyz0./-_%~^$"
ORDER = 4
FOLDS = 5
GROUPS = ("allowed", "blocked")
#: Fixed rules: (rule, verdict).
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def with_rule(pages: DataFrame, rules=RULES) -> DataFrame:
    """Adds ``rule`` and ``ruled`` (its verdict): the longest fitting rule's, or null."""
    rule = ruled = F.lit(None).cast("string")
    for text, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        host, slash, rest = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + rest)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        ruled = F.when(fits, F.lit(verdict)).otherwise(ruled)
    return pages.withColumn("rule", rule).withColumn("ruled", ruled)


def model_text(host: Column, path: Column, order: int) -> Column:
    """What the models read: host and path, lower-cased, digits as 0, other
    characters as ~, between start and end marks."""
    text = F.translate(F.concat(host, path), _UPPER + "123456789", _LOWER + "000000000")
    return F.concat(F.lit("^" * order), F.regexp_replace(text, r"[^a-z0./\-_%]", "~"), F.lit("$"))


def grams(urls: DataFrame, order: int) -> DataFrame:
    """One row per character of ``text``: ``gram``, the character and its
    ``order`` predecessors."""
    at = F.explode(F.sequence(F.lit(1), F.length("text") - order))
    return urls.withColumn("_at", at).withColumn("gram", F.expr(f"substring(text, _at, {order + 1})")).drop("_at", "text")


def probabilities(every: DataFrame, shorter: DataFrame | None, k: int, order: int) -> DataFrame:
    """(``gram``, ``allowed``, ``blocked``): both groups' smoothed probability of
    the last character of each gram of ``k`` + 1 characters after the others.
    ``every``: (``gram``, ``allowed``, ``blocked``) counts of all grams of
    ``order`` + 1 characters, 0 for those that a group has not; ``shorter``: the
    probabilities of one character less (none: uniform).
    """
    mine = every.groupBy(F.expr(f"substring(gram, {order - k + 1})").alias("gram")).agg(
        *[F.sum(g).alias(g) for g in GROUPS])
    ctx = Window.partitionBy(F.expr(f"substring(gram, 1, {k})"))  # a row for each character at most
    ask = mine.select("gram", F.expr("substring(gram, 2)").alias("_less"), *GROUPS, *[
        f.over(ctx).alias(f"_{n}_{g}") for g in GROUPS
        for n, f in (("total", F.sum(g)), ("kinds", F.sum((F.col(g) > 0).cast("long"))))])
    if shorter is None:
        ask = ask.withColumns({f"_lower_{g}": F.lit(1.0 / (len(ALPHABET) + 1)) for g in GROUPS})
    else:
        ask = ask.join(shorter.select(F.col("gram").alias("_less"), *[F.col(g).alias(f"_lower_{g}") for g in GROUPS]),
                       "_less")

    def smoothed(g):
        n, total, kinds, lower = F.col(g), F.col(f"_total_{g}"), F.col(f"_kinds_{g}"), F.col(f"_lower_{g}")
        return F.when(total > 0, (n + kinds * lower) / (total + kinds)).otherwise(lower).alias(g)
    return ask.select("gram", *[smoothed(g) for g in GROUPS])


def judge(pages: DataFrame, rules=RULES, order: int = ORDER, folds: int = FOLDS) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict``, and ``ratio``, the
    models' mean log-ratio (accepted over rejected) for each URL."""
    spark = pages.sparkSession
    root = scratch_path(spark, "url-filter")

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{root}/{name}")
        return spark.read.parquet(f"{root}/{name}")

    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    urls = with_rule(urls, rules)
    # Equal URLs are judged once; the models count them as often as they occur.
    texts = (urls.withColumn("text", model_text(F.col("host"), F.col("path"), order))
             .groupBy("text").agg(F.sum(F.when(F.col("ruled") == "allow", 1).otherwise(0)).alias("allowed"),
                                  F.sum(F.when(F.col("ruled") == "block", 1).otherwise(0)).alias("blocked"))
             .withColumn("hash", F.xxhash64("text")))
    texts = with_fold(stored(texts, "texts"), folds)
    # Grams of all texts, counted over the texts that the models see.
    seen = texts.select("text", *[F.when(~F.col("unseen"), F.col(g)).otherwise(0).alias(g) for g in GROUPS])
    every = stored(grams(seen, order).groupBy("gram").agg(*[F.sum(g).alias(g) for g in GROUPS]), "counts")
    # Both models order by order, from single characters up, each order written
    # first: the driver holds the plan of one order at a time.
    p = None
    for k in range(order + 1):
        p = stored(probabilities(every, p, k, order), f"order-{k}")
    ratio = p.select(F.col("gram").alias("_gram"), (F.log("allowed") - F.log("blocked")).alias("step"))
    rated = (grams(texts.select("text", F.col("text").alias("url_text")), order)
             .join(ratio, F.col("gram") == F.col("_gram"))
             .groupBy("url_text").agg(F.avg("step").alias("ratio")))
    rated = stored(texts.join(rated, F.col("text") == F.col("url_text")).drop("url_text"), "rated")

    cut = calibrated_cut(rated)
    verdicts = rated.crossJoin(F.broadcast(cut)).select(  # one row
        F.col("text").alias("_text"), "ratio",
        F.when(F.col("cut").isNull() | (F.col("ratio") >= F.col("cut")), "allow").otherwise("block").alias("_v"))
    return (urls.withColumn("_t", model_text(F.col("host"), F.col("path"), order))
            .join(verdicts, F.col("_t") == F.col("_text"))
            .select("page_id", "host", "path", "rule", F.coalesce("ruled", "_v").alias("verdict"), "ratio"))


def with_fold(texts: DataFrame, folds: int) -> DataFrame:
    """``unseen`` in place of ``hash``: the texts kept from the models, one of
    ``folds`` by hash.  Of each group the first text by (hash modulo folds,
    hash) is always unseen and the last never, so that a group of two texts or
    more has both kinds."""
    place = F.struct(F.pmod("hash", F.lit(folds)).alias("fold"), "hash")
    # One row of four hashes comes to the driver.
    ends = texts.agg(*[f(F.when(F.col(g) > 0, place)).getField("hash").alias(f"{n}_{g}")
                       for g in ("allowed", "blocked") for n, f in (("first", F.min), ("last", F.max))]).first()

    def one_of(n):
        return F.col("hash").isin([v for k, v in ends.asDict().items() if k.startswith(n) and v is not None])
    unseen = ((F.pmod("hash", F.lit(folds)) == 0) | one_of("first")) & ~one_of("last")
    return texts.select("text", "allowed", "blocked", unseen.alias("unseen"))


def calibrated_cut(rated: DataFrame) -> DataFrame:
    """One row, ``cut``: as many standard deviations below the mean ratio of
    unseen accepted URLs as above that of unseen rejected ones.  A group with
    no unseen URL counts with all it has; null if a group has none."""
    def moments(group: str):
        def over(w):
            n = F.nullif(F.sum(w), F.lit(0))
            mean = F.sum(w * F.col("ratio")) / n
            return mean, F.sqrt(F.greatest(F.sum(w * F.col("ratio") * F.col("ratio")) / n - mean * mean, F.lit(0.0)))
        kept, every = over(F.when(F.col("unseen"), F.col(group)).otherwise(0)), over(F.col(group))
        return F.coalesce(kept[0], every[0]), F.coalesce(kept[1], every[1]) + 1e-6
    (m_a, s_a), (m_b, s_b) = moments("allowed"), moments("blocked")
    return rated.agg(m_a.alias("m_a"), s_a.alias("s_a"), m_b.alias("m_b"), s_b.alias("s_b")).select(
        ((F.col("m_a") * F.col("s_b") + F.col("m_b") * F.col("s_a")) / (F.col("s_a") + F.col("s_b"))).alias("cut"))
