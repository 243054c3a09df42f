"""Rows of a paged service, fetched by tasks: a page a row of offsets, with retries."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

Fetch = Callable[[int, int], list[dict]]


def fetch_page(fetch: Fetch, offset: int, length: int, retries: int, pause: float) -> list[dict]:
    """The page's rows; the last of `retries` failures is raised. Pauses double."""
    for attempt in range(retries):
        try:
            return fetch(offset, length)
        except Exception:
            if attempt + 1 == retries:
                raise
            time.sleep(pause * 2**attempt)
    return []


def read_pages(spark: SparkSession, fetch: Fetch, total: int, page: int, schema: str, tasks: int = 8, retries: int = 3, pause: float = 0.5) -> DataFrame:
    """All rows of a service that serves `total` rows by offset and length. A page that comes short ends early, not the
    read; `tasks` bounds how many pages are asked for at once."""
    offsets = spark.range(0, total, page, max(1, min(tasks, -(-total // page))))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for offset in part["id"].tolist():
                rows = fetch_page(fetch, offset, min(page, total - offset), retries, pause)
                if rows:
                    yield pd.DataFrame(rows)

    return offsets.mapInPandas(run, schema)
