"""Cleaning operators: raw flattening and coercion, schema drift, latest
snapshot / latest-per-key / de-duplication, name normalisation and the
two-key fallback join."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


# --- S3 / S4 / W2 ------------------------------------------------------------

def latest_snapshot(df: DataFrame, scope_cols, snapshot_col: str) -> DataFrame:
    """S3: rows of the lexically newest snapshot within each scope.

    One aggregate (max per scope; as many rows as scopes) joined back on
    (scope, snapshot) -- a semi join, so the big side is only filtered.
    """
    scope_cols = list(scope_cols)
    latest = df.groupBy(*scope_cols).agg(F.max(snapshot_col).alias(snapshot_col))
    return df.join(latest, scope_cols + [snapshot_col], "left_semi")


def latest_per_key(df: DataFrame, key_cols, order_cols) -> DataFrame:
    """S4/W2 keep-last: per key the row with the greatest ``order_cols``.

    ``max_by(struct(*), struct(order))`` is a partial aggregate: each map
    task pre-reduces its rows per key before the shuffle, so a key holding a
    third of the data ships one row per task, not a third of the data.
    """
    key_cols = list(key_cols)
    rest = [c for c in df.columns if c not in key_cols]
    order = F.struct(*[F.col(c) for c in order_cols])
    g = df.groupBy(*key_cols).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return g.select(*key_cols, *[F.col("_row").getField(c).alias(c) for c in rest])


def first_per_key(df: DataFrame, key_cols, order_cols) -> DataFrame:
    """W2 keep-first: per key the row with the smallest ``order_cols`` (min_by)."""
    key_cols = list(key_cols)
    rest = [c for c in df.columns if c not in key_cols]
    order = F.struct(*[F.col(c) for c in order_cols])
    g = df.groupBy(*key_cols).agg(F.min_by(F.struct(*rest), order).alias("_row"))
    return g.select(*key_cols, *[F.col("_row").getField(c).alias(c) for c in rest])


def dedupe_window(df: DataFrame, key_cols, order_cols, keep: str = "last") -> DataFrame:
    """W2 reference form (row_number == 1).  Kept for parity tests; prefer
    ``latest_per_key`` at scale (no full sort of every key group)."""
    o = [F.col(c).desc() if keep == "last" else F.col(c).asc() for c in order_cols]
    w = Window.partitionBy(*key_cols).orderBy(*o)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


# --- P1 / P2 / P3 / P4 ----------------------------------------------------------

def flatten_json(df: DataFrame, json_col: str, schema: T.StructType, keep_cols=(),
                 rename: dict | None = None, meta: dict | None = None) -> DataFrame:
    """P1+P4: parse a JSON column with a DECLARED schema (no inference),
    select/rename; keys absent from a record become typed nulls; load
    metadata columns are literals passed in (never ``now()`` in a query)."""
    rename = rename or {}
    parsed = df.select(*keep_cols, F.from_json(F.col(json_col), schema).alias("_j"))
    cols = [F.col(f"_j.{f.name}").alias(rename.get(f.name, f.name)) for f in schema.fields]
    extra = [F.lit(v).alias(k) for k, v in (meta or {}).items()]
    return parsed.select(*keep_cols, *cols, *extra)


def coerce(df: DataFrame, casts: dict) -> DataFrame:
    """``pd.to_numeric(errors='coerce')`` = ``try_cast``: bad -> null."""
    out = []
    for c in df.columns:
        if c in casts:
            out.append(F.expr(f"try_cast(`{c}` AS {casts[c]})").alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    return df.select(*out)


def schema_drift(df: DataFrame, json_col: str, expected, ignored=()) -> DataFrame:
    """Keys present in raw JSON records but not expected (minus the
    ignored names), with how many records carry each.  Key extraction is a
    JSON map parse + explode; the count is a partial aggregate."""
    keys = df.select(F.explode(F.map_keys(F.from_json(F.col(json_col), "map<string,string>"))).alias("key"))
    known = set(expected) | set(ignored)
    return (keys.where(~F.col("key").isin(sorted(known)) if known else F.lit(True))
                .groupBy("key").agg(F.count(F.lit(1)).alias("records")))


# --- X1 / J1 -----------------------------------------------------------------

def _ascii_fold(s: str) -> str:
    return unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode("ascii")


@F.pandas_udf(T.StringType())
def _ascii_fold_udf(s: pd.Series) -> pd.Series:
    """NFKD then drop non-ASCII (Arrow batch, only for non-ASCII rows)."""
    return s.map(lambda v: None if v is None else _ascii_fold(v))


def normalise_name(c) -> F.Column:
    """Name key: accents stripped (NFKD, non-ASCII dropped), lower-cased,
    '-' -> ' ', apostrophes removed, trimmed.

    Spark evaluates a Python UDF for every row of the batch even inside a
    CASE, so the UDF is fed NULL for pure-ASCII names: only non-ASCII
    strings cross into Python (Arrow batches), ASCII names are folded by
    the JVM expression alone."""
    c = F.col(c) if isinstance(c, str) else c
    is_ascii = c.rlike("^[\\x00-\\x7F]*$")
    folded = F.when(is_ascii, c).otherwise(_ascii_fold_udf(F.when(~is_ascii, c)))
    return F.trim(F.replace(F.replace(F.lower(folded), F.lit("-"), F.lit(" ")), F.lit("'"), F.lit("")))


def normalise_name_ascii(c) -> F.Column:
    """The same key for inputs known to be ASCII (no Python at all)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(F.replace(F.replace(F.lower(c), F.lit("-"), F.lit(" ")), F.lit("'"), F.lit("")))


def normalise_name_folded(c) -> F.Column:
    """X1 "folded" mode: the same key under the accent- and case-insensitive
    ``UNICODE_CI_AI`` collation, so Ødegaard = odegaard and Łukasz = lukasz
    (the strict NFKD fold drops Ø and Ł instead).  Pure JVM: equality,
    grouping and joins on the collated key are collation-aware."""
    c = F.col(c) if isinstance(c, str) else c
    return F.collate(F.trim(F.replace(F.replace(c, F.lit("-"), F.lit(" ")), F.lit("'"), F.lit(""))),
                     "UNICODE_CI_AI")


def fallback_name_join(left: DataFrame, right: DataFrame, full_col: str, short_col: str,
                       right_name: str, right_pos: str, stat_cols, prefix: str = "",
                       norm=normalise_name) -> DataFrame:
    """Left join on the normalised full name; rows still unmatched try
    the normalised short name.  The right side is de-duplicated keep-first
    by ``right_pos`` (min_by, a partial aggregate).  "Unmatched" is tested
    on the first stat column being null, as in the product."""
    stat_cols = list(stat_cols)
    r = right.select(norm(right_name).alias("_key"), F.col(right_pos).alias("_pos"), *stat_cols)
    r = first_per_key(r, ["_key"], ["_pos"]).drop("_pos")
    full = r.select(F.col("_key").alias("_kf"), *[F.col(c).alias(f"_f_{c}") for c in stat_cols])
    short = r.select(F.col("_key").alias("_ks"), *[F.col(c).alias(f"_s_{c}") for c in stat_cols])
    l2 = left.select("*", norm(full_col).alias("_nf"), norm(short_col).alias("_ns"))
    j = l2.join(full, l2["_nf"] == full["_kf"], "left").join(short, l2["_ns"] == short["_ks"], "left")
    first = stat_cols[0]
    hit_full = F.col(f"_f_{first}").isNotNull()
    out = [F.col(f"`{c}`") for c in left.columns]
    for c in stat_cols:
        out.append(F.when(hit_full, F.col(f"_f_{c}")).otherwise(F.col(f"_s_{c}")).alias(prefix + c))
    out.append(F.when(hit_full, F.lit("full")).when(F.col(f"_s_{first}").isNotNull(), F.lit("short"))
               .otherwise(F.lit(None)).alias("matched_on"))
    return j.select(*out)
