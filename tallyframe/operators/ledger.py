"""Usage ledgers: token cost reports, period budgets, budget admission
(exclusive running spend), sliding-window rate admission and attempt rates."""

from __future__ import annotations

from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.operators.ranking import prefix_sum_within_key, idle_pieces, range_count_within_key

# USD per million tokens (input, output).  Two price lists
# exist in the product: the enrichment report (unknown model -> 0) and the
# agent budget (unknown model -> the most expensive fallback).
ENRICH_RATES = {
    "claude-haiku-4-5-20251001": ("0.25", "1.25"),
    "claude-sonnet-4-6": ("3.0", "15.0"),
}
AGENT_RATES = {
    "claude-haiku-4-5": ("1.0", "5.0"),
    "claude-sonnet-4-6": ("3.0", "15.0"),
}
AGENT_FALLBACK = ("3.0", "15.0")

RATE_T = "decimal(10,4)"
COST_T = "decimal(18,6)"


def rates_frame(spark: SparkSession, rates: dict) -> DataFrame:
    """A price list as a (tiny, fixed-size) DataFrame."""
    rows = [(m, Decimal(i), Decimal(o)) for m, (i, o) in rates.items()]
    schema = T.StructType([T.StructField("model", T.StringType()),
                           T.StructField("input_per_mtok", T.DecimalType(10, 4)),
                           T.StructField("output_per_mtok", T.DecimalType(10, 4))])
    return spark.createDataFrame(rows, schema)


def _cost(in_tok, out_tok, in_rate, out_rate):
    """Exact DECIMAL cost: tokens x rate / 1e6, rounded half-even to 6 dp."""
    mega = F.lit(Decimal("0.000001")).cast("decimal(7,6)")
    raw = (in_tok.cast("decimal(12,0)") * in_rate + out_tok.cast("decimal(12,0)") * out_rate) * mega
    return F.bround(raw, 6).cast(COST_T)


def with_cost(usage: DataFrame, rates: DataFrame, fallback=None) -> DataFrame:
    """Price every usage row (broadcast of the fixed price list);
    unknown models cost 0, or the fallback rate when one is given."""
    j = usage.join(F.broadcast(rates), "model", "left")
    zero = F.lit(Decimal("0")).cast(RATE_T)
    fi = F.lit(Decimal(fallback[0])).cast(RATE_T) if fallback else zero
    fo = F.lit(Decimal(fallback[1])).cast(RATE_T) if fallback else zero
    return j.select(*[F.col(c) for c in usage.columns],
                    _cost(F.col("input_tokens"), F.col("output_tokens"),
                          F.coalesce("input_per_mtok", fi), F.coalesce("output_per_mtok", fo)).alias("cost_usd"))


def cost_report(usage: DataFrame, rates: DataFrame) -> DataFrame:
    """Tokens and cost per (node, model) plus the grand total (ROLLUP).

    Costs are per-row exact decimals, so the sums are order-independent."""
    c = with_cost(usage, rates)
    r = c.rollup("node", "model").agg(
        F.sum("input_tokens").cast("bigint").alias("input_tokens"),
        F.sum("output_tokens").cast("bigint").alias("output_tokens"),
        F.sum("cost_usd").cast(COST_T).alias("cost_usd"),
        F.grouping_id().alias("_gid"))
    # keep (node, model) rows and the grand total; drop the per-node subtotals
    return r.where(F.col("_gid").isin(0, 3)).select(
        F.coalesce("node", F.lit("all")).alias("node"), F.coalesce("model", F.lit("all")).alias("model"),
        "input_tokens", "output_tokens", "cost_usd")


def budget_ledger(priced: DataFrame, period_col: str, limit_usd: str) -> DataFrame:
    """Spend per period, remaining budget and the exceeded flag."""
    lim = F.lit(Decimal(limit_usd)).cast(COST_T)
    g = priced.groupBy(period_col).agg(
        F.count(F.lit(1)).alias("requests"),
        F.sum(F.col("input_tokens") + F.col("output_tokens")).cast("bigint").alias("tokens"),
        F.sum("cost_usd").cast(COST_T).alias("spend_usd"))
    return g.select(period_col, "requests", "tokens", "spend_usd", lim.alias("limit_usd"),
                    F.greatest(lim - F.col("spend_usd"), F.lit(Decimal("0")).cast(COST_T)).cast(COST_T)
                    .alias("remaining_usd"),
                    (F.col("spend_usd") >= lim).alias("exceeded"))


def budget_admission(priced: DataFrame, period_col: str, order_cols, limit_usd: str) -> DataFrame:
    """A request is admitted iff the spend BEFORE it (same period) is
    below the limit; ``crossed`` marks the first request whose inclusive
    spend reaches the limit (``exceeded_at``).  Costs are >= 0, so this is
    an exclusive running sum -- computed skew-safe (range partitions +
    per-piece offsets), not a window over a whole period."""
    lim = F.lit(Decimal(limit_usd)).cast(COST_T)
    r = prefix_sum_within_key(priced, [period_col], order_cols, "cost_usd", "_before", inclusive=False)
    before = F.coalesce(F.col("_before"), F.lit(Decimal("0")).cast(COST_T))
    after = before + F.col("cost_usd")
    return r.select(*priced.columns, before.cast(COST_T).alias("spend_before"),
                    (before < lim).alias("allowed"), ((before < lim) & (after >= lim)).alias("crossed"))


def rate_admission(requests: DataFrame, short_s: float = 60, short_n: int = 5,
                   long_s: float = 3600, long_n: int = 20) -> DataFrame:
    """W9 batch form over (session_id, request_id, t seconds).

    Sessions are cut where nothing was attempted for more than the long window:
    whatever was accepted before such a gap is out of both windows after it, so
    the pieces are independent and exact (``idle_pieces``).  Pieces are
    hash-partitioned, sorted, and passed once (``mapInPandas``) with at most
    ``long_n`` accepted timestamps as state, carried across Arrow batches.  A
    session holding a third of all requests is spread over many tasks; a
    stretch without a gap is sequential by definition, since a rejection
    changes every later decision, and is passed in constant memory.
    """
    from collections import deque

    def run(batches):
        cur, win = None, deque()
        for pdf in batches:
            sid, rid = pdf["session_id"], pdf["request_id"].to_numpy()
            ts = pdf["t"].to_numpy(dtype="float64")
            allowed, retry = [], []
            for s, now in zip(zip(sid.astype(object).where(sid.notna(), None), pdf["_piece"]), ts):
                if s != cur:
                    cur, win = s, deque()
                while win and win[0] < now - long_s:
                    win.popleft()
                in_short = [x for x in win if x >= now - short_s]
                if len(in_short) >= short_n:
                    allowed.append(False)
                    retry.append(max(1, int(short_s - (now - in_short[0]))))
                elif len(win) >= long_n:
                    allowed.append(False)
                    retry.append(max(1, int(long_s - (now - win[0]))))
                else:
                    win.append(now)
                    allowed.append(True)
                    retry.append(None)
            yield pd.DataFrame({"session_id": sid.astype("Int64"), "request_id": rid, "allowed": allowed,
                                "retry_after": pd.array(retry, dtype="Int64")})

    schema = "session_id bigint, request_id bigint, allowed boolean, retry_after bigint"
    r = idle_pieces(requests.select("session_id", "request_id", "t"), ["session_id"], "t", ["request_id"], long_s)
    n = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (r.repartition(n, "session_id", "_piece").sortWithinPartitions("session_id", "_piece", "t", "request_id")
             .mapInPandas(run, schema))


def attempt_rate(requests: DataFrame, span_s: int) -> DataFrame:
    """T5 batch twin: attempts (admitted or not) per session in the trailing
    span -- a RANGE window count computed skew-safe (a hot session is split
    across range partitions; see ``ranking.range_count_within_key``)."""
    r = range_count_within_key(requests.select("session_id", "request_id", "t"), ["session_id"], "t",
                               "request_id", span_s, out="attempts")
    return r.select("session_id", "request_id", "attempts")
