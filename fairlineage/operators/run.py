"""A whole attribution run: joined tuples, their games, values, totals per owner, and what it took."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, functions as F

from ..session import cut
from ..sources.results import result_document, write_result
from ..sources.tables import Dataset
from . import games as G
from . import shapley as V


def totals_of_shapes(shapes: DataFrame, method: str, **settings) -> DataFrame:
    """(owner_id, sv): values of all shapes, summed over the tuples that have them."""
    values = V.attribute(G.shape_terms(shapes), method, **settings).select(
        "game_id", F.col("owner_id").alias("place"), "sv")
    return shapes.join(values, ["game_id", "place"]).groupBy("owner_id").agg(
        F.sum(F.col("sv") * F.col("tuples")).alias("sv"))


def run_attribution(dataset: Dataset, method: str = "rdsv", path: str | None = None, count_first: bool = True,
                    **settings) -> tuple[DataFrame, DataFrame]:
    """(values, document): the total of every owner over all joined tuples, and the result document with measured times.

    ``method`` and ``settings`` as for :func:`shapley.attribute`. Loading ends when the shapes of all tuples are written,
    calculation when the totals are. With ``path`` both results are written there.
    """
    start = time.monotonic()
    shapes = cut(G.tuple_shapes(G.lineage(dataset, texts=True), count_first=count_first))
    loaded = time.monotonic()
    values = cut(totals_of_shapes(shapes, method, **settings))
    done = time.monotonic()
    document = result_document(values, method=method, sample_size=settings.get("sample_size"), load_seconds=loaded - start,
                               cal_seconds=done - loaded, total_seconds=done - start)
    if path is not None:
        write_result(document, values, path)
    return values, document
