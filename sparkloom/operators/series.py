"""Time series and change points."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.coerce import epoch_ms, num
from .filters import Filter, apply_filters
from .ordering import with_halo, with_row_index
from .sampling import PRESETS, sample_rows


def _points(df: DataFrame, value: str, x: str, order_by: Sequence[str], filters: Sequence[Filter] | None, missing: str) -> tuple[DataFrame, list[Column]]:
    """(x, y, row order): y is 0 where it isn't a number, unless ``missing='drop'``."""
    rows = apply_filters(df, filters)
    kind = df.schema[x].dataType if x != "index" else None
    if kind is None:
        key = F.lit(None).cast("double")
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        key = F.unix_millis(F.col(f"`{x}`").cast("timestamp")).cast("double")
    else:
        key = F.coalesce(F.when(F.lit(isinstance(kind, T.StringType)), epoch_ms(F.col(f"`{x}`").cast("string"))).cast("double"), num(df, x))
    y = num(df, value)
    out = rows.select(key.alias("x"), (y if missing == "drop" else F.coalesce(y, F.lit(0.0))).alias("y"), *(F.col(f"`{c}`").alias(f"__o{i}") for i, c in enumerate(order_by)))
    return (out.where("y is not null") if missing == "drop" else out), [F.col("x"), *(F.col(f"__o{i}") for i in range(len(order_by)))]


def time_series(df: DataFrame, value: str, x: str = "index", order_by: Sequence[str] = (), filters: Sequence[Filter] | None = None, points: int = PRESETS["timeseries"], missing: str = "zero") -> DataFrame:
    """(index, x, value, moving_average, trend, direction) of at most ``points`` rows in the order of x.

    The moving average trails over max(3, n / 20) rows; the trend is the least-squares line over positions.
    """
    pts, order = _points(df, value, x, order_by, filters, missing)
    sampled = sample_rows(pts, order, points).select("row_index", F.coalesce("x", F.col("row_index").cast("double")).alias("x"), "y")
    n = F.count("*").over(Window.partitionBy())
    small = sampled.withColumn("index", (F.row_number().over(Window.orderBy("row_index")) - 1).cast("long")).withColumn("n", n)
    w = F.greatest(F.lit(3), F.floor(F.col("n") / 20))
    total = F.sum("y").over(Window.orderBy("index"))
    running = small.withColumn("s", total).withColumn("w", w)
    # a frame whose length is only known from the data: differences of running sums
    lagged = running.select(F.col("index").alias("j"), F.col("s").alias("s0"))
    joined = running.join(F.broadcast(lagged), F.col("j") == F.col("index") - F.col("w"), "left")
    average = (F.col("s") - F.coalesce("s0", F.lit(0.0))) / F.least(F.col("w"), F.col("index") + 1)
    line = small.agg(F.regr_slope("y", "index").alias("a"), F.regr_intercept("y", "index").alias("b"))
    direction = F.when(F.col("a") > 0, "increasing").when(F.col("a") < 0, "decreasing").otherwise("stable")
    return joined.crossJoin(F.broadcast(line)).select("index", "x", F.col("y").alias("value"), average.alias("moving_average"), (F.col("a") * F.col("index") + F.col("b")).alias("trend"), direction.alias("direction"))


def time_buckets_sql(df: DataFrame, value: str, time: str, interval: str = "day", filters: Sequence[Filter] | None = None) -> DataFrame:
    """(period, value, count): the mean by hour, day, ISO week or month, both columns not null."""
    t = F.col(f"`{time}`")
    forms = {"hour": F.date_format(t, "yyyy-MM-dd HH:00:00"), "day": F.date_format(t, "yyyy-MM-dd"), "month": F.date_format(t, "yyyy-MM")}
    forms["week"] = F.concat(F.date_part(F.lit("YEAROFWEEK"), t).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(t).cast("string"), 2, "0"))
    rows = apply_filters(df, filters).where(t.isNotNull() & F.col(f"`{value}`").isNotNull())
    return rows.groupBy(forms[interval].alias("period")).agg(F.avg(f"`{value}`").alias("value"), F.count("*").alias("count"))


def change_points_sql(df: DataFrame, value: str, order_by: Sequence[str], filters: Sequence[Filter] | None = None) -> DataFrame:
    """(index, value, score, confidence): trailing means of 5 and 10 rows that part by over two standard deviations."""
    rows = apply_filters(df, filters).where(F.col(f"`{value}`").isNotNull())
    indexed = with_row_index(rows, order_by).select("row_index", F.col(f"`{value}`").cast("double").alias("value"))
    w = Window.partitionBy("chunk").orderBy("row_index")
    scored = with_halo(indexed, 9).withColumn("m10", F.avg("value").over(w.rowsBetween(-9, 0))).withColumn("m5", F.avg("value").over(w.rowsBetween(-4, 0))).where("own")
    scored = scored.select((F.col("row_index") + 1).alias("index"), "value", F.abs(F.col("m5") - F.col("m10")).alias("score")).where(F.col("index") > 10)
    limit = scored.agg((F.avg("score") + 2 * F.stddev_samp("score")).alias("threshold"))
    return scored.crossJoin(F.broadcast(limit)).where("score > threshold").select("index", "value", "score", F.least(F.try_divide(F.col("score"), F.col("threshold")), F.lit(1.0)).alias("confidence"))


def cusum(x: np.ndarray, drift: float = 1.0, threshold: float = 5.0) -> list[tuple[int, float]]:
    """Sums of deviations from the mean beyond ``drift``, up and down; both start anew after each hit."""
    mean, up, down, out = x.mean(), 0.0, 0.0, []
    for i, v in enumerate(x.tolist()):
        up, down = max(0.0, up + v - mean - drift), min(0.0, down + v - mean + drift)
        if up > threshold or -down > threshold:
            out.append((i, min(max(up, -down) / threshold, 3) / 3))
            up = down = 0.0
    return out


def ewma(x: np.ndarray, weight: float = 0.1, threshold: float = 3.0) -> list[tuple[int, float]]:
    """Points farther from an exponentially weighted mean than ``threshold`` standard deviations."""
    sigma, e, out = x.std(), x.mean(), []
    for i, v in enumerate(x.tolist()):
        e = weight * v + (1 - weight) * e
        if sigma > 0 and abs(v - e) / sigma > threshold:
            out.append((i, min(abs(v - e) / sigma / threshold, 3) / 3))
    return out


def binary_segmentation(x: np.ndarray, least: int = 5, accept: float = 0.1) -> list[tuple[int, float]]:
    """Splits that minimise the squared error of both sides, against the error of the whole series, as deep as they go."""
    s1, s2 = np.concatenate([[0], np.cumsum(x)]), np.concatenate([[0], np.cumsum(x * x)])
    sse = lambda a, b: s2[b] - s2[a] - (s1[b] - s1[a]) ** 2 / np.maximum(b - a, 1)
    whole, out, todo = sse(0, len(x)), [], [(0, len(x))]
    while todo and whole > 0:
        a, b = todo.pop()
        at = np.arange(a + least, b - least)
        if not len(at):
            continue
        score = sse(a, at) + sse(at, b)
        k = int(score.argmin())
        sure = min(1 - score[k] / whole, 1)
        if sure > accept:
            out.append((int(at[k]), float(sure)))
            todo += [(a, int(at[k])), (int(at[k]), b)]
    return sorted(out)


def moving_average(x: np.ndarray, exact_reference: bool = False) -> list[tuple[int, float]]:
    """Points where the means of the windows before and after part by over two standard deviations.

    ``exact_reference`` slides the window after the point in the way of the reference, which is not the mean after it.
    """
    n, w = len(x), max(3, min(10, len(x) // 20))
    limit = 2 * x.std()
    i = np.arange(w, n - w)
    if not len(i) or limit == 0:
        return []
    sums = np.concatenate([[0], np.cumsum(x)])
    before, after = (sums[i] - sums[i - w]) / w, (sums[i + w] - sums[i]) / w
    if exact_reference:
        first = sums[2 * w] - sums[w]
        after = np.where(i == w, first / w, (first - x[min(2 * w, n - 1)] + x[np.minimum(i + w, n - 1)]) / w)
    d = np.abs(after - before)
    return [(int(k), float(min(v / limit, 3) / 3)) for k, v in zip(i, d, strict=True) if v > limit]


ALGORITHMS: dict[str, Callable[..., list[tuple[int, float]]]] = {"moving_average": moving_average, "cusum": cusum, "ewma": ewma, "binary_segmentation": binary_segmentation}


def change_points(
    df: DataFrame, value: str, x: str = "index", order_by: Sequence[str] = (), algorithm: str = "moving_average", filters: Sequence[Filter] | None = None, points: int = PRESETS["changepoint"], missing: str = "zero", **options
) -> DataFrame:
    """(index, x, value, confidence, level) by one of ALGORITHMS, for at most ``points`` rows; fewer than 10 give none.

    A series is bounded by ``points``, so one task runs its recurrence.
    """
    pts, order = _points(df, value, x, order_by, filters, missing)
    sampled = sample_rows(pts, order, points).select("row_index", F.coalesce("x", F.col("row_index").cast("double")).alias("x"), "y")
    run = ALGORITHMS[algorithm]

    def detect(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_index")
        hits = run(pdf["y"].to_numpy(float), **options) if len(pdf) >= 10 else []
        at = [i for i, _ in hits]
        return pd.DataFrame({"index": pd.Series(at, dtype="int64"), "x": pdf["x"].to_numpy(float)[at], "value": pdf["y"].to_numpy(float)[at], "confidence": pd.Series([c for _, c in hits], dtype=float)})

    found = sampled.groupBy(F.lit(0).alias("__series")).applyInPandas(detect, "index long, x double, value double, confidence double")
    level = F.when(F.col("confidence") >= 0.8, "very high").when(F.col("confidence") >= 0.6, "high").when(F.col("confidence") >= 0.4, "medium").otherwise("low")
    return found.withColumn("level", level)
