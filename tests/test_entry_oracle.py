"""Driver contract: entry() smoke, catalogue/oracle consistency, every
query against its DuckDB oracle on the smallest tables, and the
rows-only twins (streaming admission == batch admission)."""

import math
import re

import duckdb
import pytest

import __spark_entry__ as E
from tallyframe.sources.tables import TABLE_NAMES
from tests.conftest import SF_SMALL

ROWS_ONLY: set = set()


def core(names):
    """The catalogue without the optional subpackage's queries (tests/llm)."""
    return {n for n in names if n != "pipeline" and not re.match(r"op\d+_", n)}


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "composite_score" in df.columns and "composite_rank" in df.columns


def test_catalogue_and_oracles_line_up():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert core(q) - set(o) == ROWS_ONLY
    assert len(core(q)) >= 90


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLE_NAMES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


@pytest.mark.parametrize("name", sorted(core(E.oracle_sql())))
def test_query_matches_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SF_SMALL)
    cols = sorted(sdf.columns)
    srows = sorted((tuple(_norm(r[c]) for c in cols) for r in sdf.collect()), key=repr)
    rel = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in rel.description]
    assert sorted(dcols) == cols
    idx = [dcols.index(c) for c in cols]
    drows = sorted((tuple(_norm(r[i]) for i in idx) for r in rel.fetchall()), key=repr)
    assert srows == drows


def test_stream_admission_equals_batch(spark):
    a = {r.request_id: r.allowed for r in E.queries()["stream_admission"](spark, SF_SMALL).collect()}
    b = {r.request_id: r.allowed for r in E.queries()["rate_admission"](spark, SF_SMALL).collect()}
    assert a == b and len(a) > 0


def test_rows_only_queries_run(spark):
    for n in ["knn_cells"]:
        assert E.queries()[n](spark, SF_SMALL).count() > 0


def test_bench_prints_one_json_line():
    import json
    import os
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = dict(os.environ, BENCH_SF_DIR=SF_SMALL, BENCH_CPUS="2")
    out = subprocess.run([sys.executable, os.path.join(root, "bench.py"), "fixture_fdr", "team_strength"],
                         capture_output=True, text=True, env=env, timeout=600, check=True).stdout
    lines = [x for x in out.splitlines() if x.strip()]
    assert len(lines) == 1
    d = json.loads(lines[0])
    assert {"metric", "value", "unit", "queries", "sf"} <= set(d) and d["unit"] == "sec"
    assert set(d["queries"]) == {"fixture_fdr", "team_strength"} and d["sf"] == 0.001
