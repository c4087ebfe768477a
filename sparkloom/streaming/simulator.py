"""A made-up table for trying things out, whole or as a stream, with missing values put in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = ("データ", "分析", "テスト")


def with_missing(c: Column, rate: float, number: bool, seed: int) -> Column:
    """The value, or with a chance of ``rate`` % nothing: null, or for text empty, or for numbers zero."""
    pick = F.floor(F.rand(seed + 1) * 3)
    gone = F.when(pick == 1, F.lit(0).cast("double") if number else F.lit("")).otherwise(F.lit(None))
    return F.when(F.rand(seed) * 100 < rate, gone).otherwise(c)


def _columns(i: Column, rate: float, seed: int) -> dict[str, Column]:
    u = lambda k, a, b, d: F.round(F.rand(seed + k) * (b - a) + a, d)
    pick = lambda k, xs: F.element_at(F.array(*map(F.lit, xs)), (F.floor(F.rand(seed + k) * len(xs)) + 1).cast("int"))
    numbers = {"temperature": u(10, 10, 50, 2), "humidity": u(20, 30, 90, 2), "pressure": u(30, 950, 1150, 2), "sales": u(40, 1000, 11000, 0), "score": u(50, 60, 100, 2)}
    texts = {"category": pick(60, "ABC"), "status": pick(70, ("active", "inactive")), "description": F.concat(F.lit("Sample text data "), i.cast("string"), F.lit(" - "), pick(80, WORDS))}
    out = {k: with_missing(v, rate, True, seed + 100 + 10 * n) for n, (k, v) in enumerate(numbers.items())}
    return out | {k: with_missing(v, rate, False, seed + 200 + 10 * n) for n, (k, v) in enumerate(texts.items())}


def sample_table(spark: SparkSession, rows: int = 20, rate: float = 10.0, seed: int = 42, start: int = 1) -> DataFrame:
    """id, timestamp a minute apart, five numbers and three texts."""
    ids = spark.range(start, start + rows)
    t = F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 60)
    return ids.select("id", t.alias("timestamp"), *(c.alias(k) for k, c in _columns(F.col("id"), rate, seed).items()))


def simulate(spark: SparkSession, rows_per_second: int = 1, rate: float = 10.0, seed: int = 42) -> DataFrame:
    """The same table as an endless stream with rising ids."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return ticks.select((F.col("value") + 1).alias("id"), "timestamp", *(c.alias(k) for k, c in _columns(F.col("value") + 1, rate, seed).items()))
