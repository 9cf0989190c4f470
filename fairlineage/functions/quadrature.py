"""Gauss–Legendre nodes on [0, 1] as a table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import ship_package


def gauss_legendre(q: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and weights on [0, 1], by Newton steps on the Legendre recurrence (O(q) memory)."""
    x = np.cos(np.pi * (np.arange(1, q + 1) - 0.25) / (q + 0.5))
    for _ in range(100):
        before, here = np.ones_like(x), x.copy()
        for k in range(2, q + 1):
            before, here = here, ((2 * k - 1) * x * here - (k - 1) * before) / k
        slope = q * (x * here - before) / (x * x - 1)
        step = here / slope
        x = x - step
        if np.max(np.abs(step)) < 1e-15:
            break
    before, here = np.ones_like(x), x.copy()
    for k in range(2, q + 1):
        before, here = here, ((2 * k - 1) * x * here - (k - 1) * before) / k
    slope = q * (x * here - before) / (x * x - 1)
    return (x + 1) / 2, 1 / ((1 - x * x) * slope * slope)


def nodes_for(games: DataFrame) -> DataFrame:
    """(game_id, q, t, w) for ``games(game_id, n)``: ⌈n/2⌉ nodes integrate degree n−1 exactly."""
    ship_package(games.sparkSession)
    sized = games.withColumn("_q", F.greatest(F.ceil(F.col("n") / 2), F.lit(1)).cast("int"))

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for size in batch["_q"]:
                t, w = gauss_legendre(int(size))
                yield pd.DataFrame({"_q": np.int32(size), "q": np.arange(size, dtype=np.int32), "t": t, "w": w})

    rules = sized.select("_q").distinct().mapInPandas(make, "_q int, q int, t double, w double")
    return sized.join(rules, "_q").select("game_id", "q", "t", "w")
