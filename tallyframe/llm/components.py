"""Connected components of a link table, as DataFrame joins.

Alternating large-star and small-star steps: every step links each vertex's
larger (smaller) neighbours straight to its smallest neighbour, until the
links form stars around the components' smallest vertices.  Hubs are
aggregated before they are exchanged and joined between plain exchanges, so a
vertex with very many links is split rather than collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.session import scratch_path


def components(links: DataFrame) -> DataFrame:
    """(``node``, ``root``) of every vertex of ``links`` (``a``, ``b``); the
    root is the component's smallest vertex.  Links to itself are ignored."""
    spark = links.sparkSession
    root = scratch_path(spark, "components")

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{root}/{name}")
        return spark.read.parquet(f"{root}/{name}")

    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                   .distinct(), "edges")
    step = 0
    while True:
        # large star: larger neighbours of u go to the smallest of u and its neighbours
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(
            F.col("u").alias("c"), F.least("u", "m").alias("m"))
        large = stored(both.join(low, F.col("u") == F.col("c")).where("v > u and v > m")
                       .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), f"large-{step}")
        # small star: u and its smaller neighbours go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), "m")
        moved = large.join(low, F.col("u") == F.col("c")).select(
            F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v")
        new = stored(moved.distinct(), f"small-{step}")
        if _same(edges, new):
            break
        edges, step = new, step + 1
    return new.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        new.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def _same(a: DataFrame, b: DataFrame) -> bool:
    def mark(df):
        h = F.xxhash64("u", "v").cast("decimal(38,0)")
        return df.agg(F.count(F.lit(1)), F.sum(h)).first()
    return tuple(mark(a)) == tuple(mark(b))
