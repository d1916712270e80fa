"""A pluggable record source: keyed lookups in batches, with retries and a resumable cache."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Fetch = Callable[[Sequence[str]], dict[str, dict]]


def network_allowed(variable: str = "DUALVIEW_NETWORK") -> bool:
    """Fetching is opt-in by environment."""
    return os.environ.get(variable, "").lower() in ("1", "true", "yes")


def fetch_batch(fetch: Fetch, ids: Sequence[str], retries: int = 3, pause: float = 0.5) -> list[tuple[str, str | None, str | None]]:
    """(id, record as JSON, error) of each id; a missing record has neither, a failed batch has its error as data."""
    error = None
    for attempt in range(retries):
        try:
            found = fetch(list(ids))
            return [(i, json.dumps(found[i], sort_keys=True) if i in found else None, None) for i in ids]
        except Exception as e:  # noqa: BLE001  whatever the service raises becomes data
            error = f"{type(e).__name__}: {e}"
            time.sleep(pause * 2**attempt)
    return [(i, None, error) for i in ids]


def lookup(keys: DataFrame, key: str, fetch: Fetch, batch: int = 100, retries: int = 3, pause: float = 0.5) -> DataFrame:
    """(key, record, error, status) for each distinct key, fetched in batches on the executors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            ids = rows[key].tolist()
            for lo in range(0, len(ids), batch):
                yield pd.DataFrame(fetch_batch(fetch, ids[lo : lo + batch], retries, pause), columns=[key, "record", "error"])

    found = keys.select(F.col(key).cast("string").alias(key)).where(F.col(key).isNotNull()).distinct().mapInPandas(run, f"`{key}` string, record string, error string")
    status = F.when(F.col("error").isNotNull(), "error").when(F.col("record").isNull(), "missing_record").otherwise("found")
    return found.withColumn("status", status)
