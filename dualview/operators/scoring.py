"""Scores from a pluggable model, in batches, with a status for each row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import score_status

Scorer = Callable[[pd.DataFrame], np.ndarray]


def score(df: DataFrame, id: str, columns: list[str], load: Callable[[], Scorer], model: str, batch: int = 64) -> DataFrame:
    """(id, model, score, status) of every row. ``load`` makes the scorer once for each task.

    A batch that fails is scored row by row; a row that fails has the error's name as status.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = load()
        for rows in batches:
            for lo in range(0, len(rows), batch):
                part = rows.iloc[lo : lo + batch]
                try:
                    values, errors = np.asarray(scorer(part), dtype=float), [None] * len(part)
                except Exception:  # noqa: BLE001
                    values, errors = np.full(len(part), np.nan), [None] * len(part)
                    for i in range(len(part)):
                        try:
                            values[i] = float(np.asarray(scorer(part.iloc[i : i + 1]))[0])
                        except Exception as e:  # noqa: BLE001
                            errors[i] = f"failed_{type(e).__name__}"
                yield pd.DataFrame({id: part[id].astype(str), "score": values, "error": errors})

    kept = df.select(F.col(id).cast("string").alias(id), *[c for c in columns if c != id])
    out = kept.mapInPandas(run, f"`{id}` string, score double, error string")
    status = F.coalesce("error", score_status(F.col("score")))
    return out.select(id, F.lit(model).alias("model"), F.when(status == "scored", F.col("score")).alias("score"), status.alias("status"))
