"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source has a word budget (``source_targets``).  A source first gives all
its documents as many whole times as fit the budget (complete epochs); the
rest is a weighted sample without replacement: every document has the key
``-ln(u) / w``, u a repeatable uniform number from its id and w its quality
weight, and the documents with the smallest keys are taken until their
prefix sum of words meets the budget.  The document at the border gives its
first words only, so each source meets its target to within one word.

Sorting a hot source in one task is avoided: keys are cut into ``slices``
by a fixed increasing function, slice totals (pre-aggregated) tell in which
slice the border of a source lies, and only that slice is sorted.  Everything
is DataFrame expressions; the number of slices is the only bound, and a row
per source is the most that is held in one place.

Defined cases: a null text has size 0; a null source is a source of its own,
the last; a null ``doc_id`` has a key like any other value; repeated rows are
documents of their own (rows alike in every used column are interchangeable);
a source without words has target 0; an empty table gives an empty result;
columns of the input other than those used pass through ``take_documents``;
names beginning ``_mx_`` are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.session import scratch_path

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2
SLICES = 4096
_WORD = r"[^\x20\x09-\x0D]+"
_SYMBOL = r"[#*$%&|<>]"


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(_WORD)).cast("long")


def quality_weight(text: Column) -> Column:
    """Weight of a text in the fractional epoch, 0.1 to 1: high where symbols
    are rare among its characters."""
    t = F.coalesce(text, F.lit(""))
    symbols = F.regexp_count(t, F.lit(_SYMBOL))
    return F.greatest(F.lit(0.1), F.lit(1.0) - F.lit(10.0) * symbols / F.greatest(F.length(t), F.lit(1)))


def sampling_key(doc_id: Column, weight: Column, seed: str = "mix") -> Column:
    """Exponential key with rate ``weight``; the smallest keys are drawn first."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(16 ** 13))
    return -F.log(u) / weight


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
                   max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``source``, ``source_size``, ``target``: ``share`` of all words dealt to
    the sources by weight (in code point order, null last), none above
    ``max_epochs`` times its size.

    The level at which the excess settles solves sum(min(cap, level * w)) =
    total: in ascending order of cap / w, the first source that is not capped
    gives it.  ``sizes`` is (``source``, ``size``) per document.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    n = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (n % len(weights) + 1).cast("int"))
    per = (per.withColumn("w", weight).withColumn("cap", (max_epochs * F.col("source_size")).cast("double"))
           .withColumn("ratio", F.col("cap") / F.col("w")))
    upto = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = ((F.lit(share) * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(upto), F.lit(0.0)))
             / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(upto), F.lit(0.0))))
    per = per.withColumn("level", level)
    settled = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(whole)["level"]
    return per.select("source", "source_size",
                      F.least(F.col("cap"), F.coalesce(settled * F.col("w"), F.col("cap"))).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS,
        slices: int = SLICES) -> DataFrame:
    """Per document: ``doc_id``, ``source``, ``size``, ``weight``, ``source_size``,
    ``target``, ``taken`` (words, repeats counted).  The narrow table of
    sizes and keys is written once; texts are read once."""
    spark = docs.sparkSession
    path = scratch_path(spark, "mix-sizes")
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"),
                        quality_weight(F.col("text")).alias("weight"))
    sized = sized.withColumn("key", sampling_key(F.col("doc_id"), F.col("weight")))
    # An increasing map of keys to slices: key / (1 + key) spreads 0..infinity over 0..1.
    sized.withColumn("slice", F.floor(slices * F.col("key") / (1 + F.col("key"))).cast("int")).write.parquet(path)
    sized = spark.read.parquet(path)

    targets = source_targets(sized, weights, share, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = targets.withColumn("epochs", epochs.cast("long")).withColumn(
        "rest", (F.floor(F.col("target")) - F.col("epochs") * F.col("source_size")).cast("long"))
    slice_words = sized.groupBy("source", "slice").agg(F.sum("size").alias("words"))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("slice")
                                            .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    border = slice_words.withColumn("before", before)
    border = (border.join(plan.select(F.col("source").alias("_s"), "rest"), F.col("source").eqNullSafe(F.col("_s")))
              .where(F.col("before") <= F.col("rest"))
              .groupBy("source").agg(F.max(F.struct("slice", "before")).alias("b"))
              .select(F.col("source").alias("_b"), F.col("b.slice").alias("border"),
                      F.col("b.before").alias("border_before")))
    # One row per source.
    plan = plan.join(border, F.col("source").eqNullSafe(F.col("_b")), "left").drop("_b")
    plan.write.parquet(f"{path}-plan")
    plan = spark.read.parquet(f"{path}-plan").withColumnRenamed("source", "_s")

    rows = sized.join(plan, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    base = F.col("epochs") * F.col("size")
    at_border = F.coalesce(F.col("slice") == F.col("border"), F.lit(False))
    inside = rows.where(~at_border).withColumn(
        "taken", base + F.when(F.col("slice") < F.col("border"), F.col("size")).otherwise(0))
    order = Window.partitionBy("source").orderBy("key", "doc_id", "size", "weight").rowsBetween(
        Window.unboundedPreceding, -1)
    left = F.col("rest") - F.col("border_before") - F.coalesce(F.sum("size").over(order), F.lit(0))
    edge = rows.where(at_border).withColumn(
        "taken", base + F.greatest(F.lit(0), F.least(F.col("size"), left)))
    cols = ["doc_id", "source", "size", "weight", "source_size", "target", "taken"]
    return inside.select(cols).unionByName(edge.select(cols))


def take_documents(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The documents as the mix takes them: one row per whole repeat, and the
    first words where only a part is taken; those not taken are left out.

    ``mixed`` is the result of ``mix`` on the same documents.  Rows that share
    a ``doc_id`` meet by source and size as well; the same pair of rows is
    never joined twice (repeats are numbered).
    """
    number = Window.partitionBy("doc_id", "source", "_mx_size").orderBy(F.lit(0))
    a = docs.withColumn("_mx_size", n_words(F.col("text"))).withColumn("_mx_n", F.row_number().over(number))
    b = (mixed.where(F.col("taken") > 0)
         .select(F.col("doc_id").alias("_mx_id"), F.col("source").alias("_mx_source"), F.col("size").alias("_mx_s"),
                 F.col("taken").alias("_mx_taken"))
         .withColumn("_mx_m", F.row_number().over(
             Window.partitionBy("_mx_id", "_mx_source", "_mx_s").orderBy(F.col("_mx_taken").desc()))))
    on = (F.col("doc_id").eqNullSafe(F.col("_mx_id")) & F.col("source").eqNullSafe(F.col("_mx_source"))
          & (F.col("_mx_size") == F.col("_mx_s")) & (F.col("_mx_n") == F.col("_mx_m")))
    rows = a.join(b, on)
    whole = F.floor(F.col("_mx_taken") / F.col("_mx_size")).cast("int")
    part = (F.col("_mx_taken") % F.col("_mx_size")).cast("int")
    # Words with the white space before them; the first ``part`` are kept.
    first = F.array_join(F.slice(F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"), 1,
                                 F.greatest(F.col("_mx_part"), F.lit(1))), "")
    rows = (rows.withColumn("_mx_whole", whole).withColumn("_mx_part", part)
            .withColumn("_mx_parts", F.concat(F.array_repeat(F.lit(False), F.col("_mx_whole")),
                                              F.when(F.col("_mx_part") > 0, F.array(F.lit(True)))
                                              .otherwise(F.array().cast("array<boolean>"))))
            .withColumn("_mx_cut", F.explode("_mx_parts"))
            .withColumn("text", F.when(F.col("_mx_cut"), first).otherwise(F.col("text"))))
    return rows.select(docs.columns)
