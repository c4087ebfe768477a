"""Down-sampling of ordered rows by row index."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import with_halo, with_row_index
from .ranks import rows_at

PRESETS = {"chart": 1000, "timeseries": 1500, "changepoint": 2000}


def places(method: str, n: int, points: int, seed: int = 0) -> list[int]:
    """The places of the rows that a sample of n rows takes."""
    if method == "uniform":  # 0, the rounded multiples of n / points, and n - 1
        return sorted({0, n - 1, *(math.floor(i * (n / points) + 0.5) for i in range(1, points - 1))})
    if method == "systematic":
        step = n // points
        return [seed % step + i * step for i in range(points) if seed % step + i * step < n]
    if method == "stratified":  # the middle of each of as many parts as points
        size = n / points
        return sorted({(math.floor(i * size) + min(math.floor((i + 1) * size), n) - 1) // 2 for i in range(points)})
    raise ValueError(f"unknown method {method!r}")


def sample_rows(df: DataFrame, order_by: Sequence[str | Column], points: int = 2000, method: str = "uniform", seed: int = 0, value: str | None = None, index: str = "row_index") -> DataFrame:
    """At most about ``points`` rows, with their index: ``uniform``, ``systematic``, ``stratified`` or ``peak``.

    Tables of no more than ``points`` rows are returned whole. ``peak`` keeps local extremes of ``value`` first and fills
    up evenly; it alone looks at neighbours and so needs every row's index. The others find the rows at their places.
    """
    if method not in ("uniform", "systematic", "stratified", "peak"):
        raise ValueError(f"unknown method {method!r}")
    n = df.count()
    if n <= points:
        return with_row_index(df, order_by, index)
    if method != "peak":
        return rows_at(df, order_by, places(method, n, points, seed), index)
    rows = with_row_index(df, order_by, index)
    i = F.col(index)
    v = F.col(f"`{value}`")
    w = Window.partitionBy("chunk").orderBy(index)
    around = with_halo(rows, 1, 1, index).withColumn("__p", F.lag(v).over(w)).withColumn("__n", F.lead(v).over(w)).where("own")
    edge = (i == 0) | (i == n - 1)
    peak = ((v > F.col("__p")) & (v > F.col("__n"))) | ((v < F.col("__p")) & (v < F.col("__n")))
    step = max(1, n // points)
    marked = around.withColumn("__r", F.when(edge, 0).when(F.coalesce(peak, F.lit(False)), 1).when(i % step == 0, 2))
    return marked.where("__r is not null").orderBy("__r", index).limit(points).drop("__p", "__n", "__r", "chunk", "own")


def sample_for(purpose: str, df: DataFrame, order_by: Sequence[str | Column]) -> DataFrame:
    return sample_rows(df, order_by, PRESETS[purpose])


def recommended(n: int) -> dict:
    """A sampling configuration for a table of n rows."""
    if n <= 1000:
        return {"points": n, "method": "none"}
    return {"points": 1000, "method": "uniform"} if n <= 10_000 else {"points": 1500, "method": "uniform"} if n <= 100_000 else {"points": 2000, "method": "stratified"}
