"""Injected batch functions over a table (X2, X4): batches of a set size that
run on across Arrow batches, errors as data, failed batches row by row."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def call_in_batches(df: DataFrame, fn: Callable[[list[dict]], list], fields, keep, batch_size: int) -> DataFrame:
    """``keep`` columns of every row with ``answer`` (JSON text), ``error`` and
    ``alone`` (whether the row was asked by itself).

    ``fn`` gets lists of ``batch_size`` dicts of ``fields``: rows left over at
    the end of an Arrow batch go into the next batch of the same partition, so
    only a partition's last batch is short.  A batch that raises, or answers
    with another number of items, is asked again row by row, and only the rows
    that fail by themselves carry an error and no answer.  What a row gets
    depends on the row alone if ``fn`` answers each item by itself; memory is
    one Arrow batch and one batch of rows.
    """
    fields, keep = list(fields), list(keep)
    names = list(dict.fromkeys([*keep, *fields]))

    def ask(rows: list[dict]) -> list:
        out = fn(rows)
        if not isinstance(out, list) or len(out) != len(rows):
            raise ValueError(f"{len(rows)} items, {len(out) if isinstance(out, list) else 'no list of'} answers")
        return out

    def answers(rows: list[dict]) -> Iterator[tuple]:
        try:
            for x in ask(rows):
                yield x, None, False
        except Exception:  # noqa: BLE001 - any failure of the injected function
            for r in rows:
                try:
                    yield ask([r])[0], None, True
                except Exception as e:  # noqa: BLE001
                    yield None, f"{type(e).__name__}: {e}", True

    def frame(kept: list[tuple], rows: list[dict]) -> pd.DataFrame:
        out = pd.DataFrame(kept, columns=keep, dtype=object)
        got = list(answers(rows))
        out["answer"] = [None if a is None else json.dumps(a, sort_keys=True) for a, _, _ in got]
        out["error"] = [e for _, e, _ in got]
        out["alone"] = [x for _, _, x in got]
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[tuple] = []
        rows: list[dict] = []
        for pdf in frames:
            pdf = pdf.astype(object).where(pdf.notna(), None)
            kept += list(pdf[keep].itertuples(index=False, name=None))
            rows += pdf[fields].to_dict("records")
            while len(rows) >= batch_size:
                yield frame(kept[:batch_size], rows[:batch_size])
                kept, rows = kept[batch_size:], rows[batch_size:]
        if rows:
            yield frame(kept, rows)

    schema = T.StructType([df.schema[c] for c in keep] + [
        T.StructField("answer", T.StringType()), T.StructField("error", T.StringType()),
        T.StructField("alone", T.BooleanType())])
    return df.select(*names).mapInPandas(run, schema)
