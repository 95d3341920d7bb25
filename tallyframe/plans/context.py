"""Per-(session, directory) context: tables, stand-in views and shared
intermediate results, built lazily and reused across queries."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.operators import curate, fixtures as fx
from tallyframe.session import scratch_path
from tallyframe.sources import standins
from tallyframe.sources.tables import Tables


class Context:
    """Lazily built, immutable DataFrame plans for one session + directory.

    Plans are reused across queries (building a plan costs thousands of
    Python->JVM calls); results are never cached implicitly.
    """

    _cache: dict = {}

    @classmethod
    def get(cls, spark: SparkSession, sf_dir: str) -> "Context":
        key = (id(spark), spark.sparkContext.applicationId, sf_dir.rstrip("/"))
        ctx = cls._cache.get(key)
        if ctx is None:
            ctx = cls._cache[key] = cls(spark, sf_dir)
        return ctx

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.t = Tables(spark, sf_dir)
        self.gw = standins.CURRENT_GW
        self.season = standins.SEASON

    # stand-ins -----------------------------------------------------------
    @cached_property
    def players(self) -> DataFrame:
        return standins.players(self.t)

    @cached_property
    def teams(self) -> DataFrame:
        return standins.teams(self.t)

    @cached_property
    def fixtures(self) -> DataFrame:
        return standins.fixtures(self.t)

    # curated chain ---------------------------------------------------------
    @cached_property
    def remaining_fixtures(self) -> DataFrame:
        """Fixtures after the current gameweek, the bound pushed to the scan."""
        return standins.fixtures(self.t, min_event=self.gw + 1)

    @cached_property
    def ticker(self) -> DataFrame:
        return fx.fixture_ticker(self.remaining_fixtures, self.teams, self.gw, self.season)

    def fixtures_window(self, window: int) -> DataFrame:
        return standins.fixtures(self.t, min_event=self.gw + 1, max_event=self.gw + window)

    @cached_property
    def fdr(self) -> DataFrame:
        return fx.fixture_fdr(self.ticker)

    @cached_property
    def dashboard(self) -> DataFrame:
        return curate.player_dashboard(self.players, self.teams, self.fdr, self.season, self.gw,
                                       standins.ADVICE_GW)

    @cached_property
    def picks(self) -> DataFrame:
        return curate.transfer_picks(self.dashboard)

    @cached_property
    def dashboard_shared(self) -> DataFrame:
        """The dashboard materialised once (a Parquet table in the shared
        ``spark.checkpoint.dir``) for the many queries downstream of it."""
        return self.materialize(self.dashboard, "dashboard")

    @cached_property
    def fdr_shared(self) -> DataFrame:
        """Per-team difficulty (one row per team), materialised once."""
        return self.materialize(self.fdr, "fdr")

    @cached_property
    def picks_shared(self) -> DataFrame:
        return curate.transfer_picks(self.dashboard_shared)

    def materialize(self, df: DataFrame, name: str = "shared") -> DataFrame:
        """Cut the lineage by writing a Parquet table into the shared
        checkpoint folder and reading it back: later queries then get column
        pruning, predicate pushdown and real size statistics (an RDD
        checkpoint would give none of these)."""
        path = scratch_path(self.spark, name)
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.parquet(path)


def flat(df: DataFrame, sep: str = "|") -> DataFrame:
    """Comparison view: arrays become ``sep``-joined strings, structs/maps JSON."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ArrayType):
            if isinstance(f.dataType.elementType, (T.StructType, T.MapType, T.ArrayType)):
                cols.append(F.to_json(c).alias(f.name))
            else:
                cols.append(F.array_join(c.cast("array<string>"), sep).alias(f.name))
        elif isinstance(f.dataType, (T.StructType, T.MapType)):
            cols.append(F.to_json(c).alias(f.name))
        else:
            cols.append(c)
    return df.select(*cols)
