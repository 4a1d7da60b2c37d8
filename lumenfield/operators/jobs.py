"""Batch work per item with outcomes instead of failures."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run(items: DataFrame, work: Callable[[dict], None], key: str) -> DataFrame:
    """(key, status, error): ``work`` is called for each row inside tasks; an exception is an outcome of its row."""
    kind = items.schema[key].dataType.simpleString()

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                try:
                    work(r)
                    rows.append((r[key], "ok", None))
                except Exception as e:  # noqa: BLE001
                    rows.append((r[key], "failed", f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[key, "status", "error"])

    return items.mapInPandas(each, f"{key} {kind}, status string, error string")


def outcome(results: DataFrame) -> DataFrame:
    return results.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
