"""Rows at given places of an order, without sorting or writing the table.

The first key is mapped to a number that never falls along the order, its range is cut into many buckets of equal width,
and one aggregation counts them. Only rows of the buckets that hold a wanted place are put in order, each bucket by
itself; a bucket of very many rows is cut again, by what is left of its range or by the next key.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordering import with_row_index

#: Buckets that a range is cut into, rows of a bucket that a task puts in order, bytes of text that one number holds.
BUCKETS, HEAVY, BYTES = 100_000, 1_000_000, 6
#: Times that a range is cut before its rows are sorted instead.
TURNS = 5


def digit(key: Column, kind: T.DataType, depth: int = 0) -> Column | None:
    """A double that never falls as the key rises (null for null), or None for a kind that has none; depth: how many pieces of a text were looked at."""
    if isinstance(kind, T.StringType):
        piece = F.substring(key.cast("binary"), 1 + depth * BYTES, BYTES)
        return F.conv(F.rpad(F.hex(piece), 2 * BYTES, "0"), 16, 10).cast("double")
    if depth:
        return None
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return key.cast("double") if isinstance(kind, T.NumericType) else key.cast("int").cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_micros(key.cast("timestamp")).cast("double")
    return None


def _buckets(x: Column, low: float, high: float, buckets: int) -> Column:
    """0 for null, 1 to ``buckets`` for numbers, one more for what is no number, which Spark orders last."""
    place = F.greatest(F.lit(0.0), F.least(F.lit(buckets - 1.0), F.floor((x - low) / (high - low) * buckets).cast("double"))) if high > low else F.when(x < low, 0.0).when(x > high, buckets - 1.0).otherwise(0.0)
    return F.when(x.isNull(), 0).when(F.isnan(x), buckets + 1).otherwise(place.cast("int") + 1)


def rows_at(df: DataFrame, order_by: Sequence[str | Column], wanted: Sequence[int], index: str = "row_index", buckets: int = BUCKETS, heavy: int = HEAVY) -> DataFrame:
    """The rows at the places ``wanted``, from 0, of ``df`` in the order of ``order_by`` (ascending, null first), with their place as ``index``.

    Rows that tie in all keys stand in any order. There are as many wanted places as a caller has in memory.
    """
    keys = [F.col(f"`{k}`") if isinstance(k, str) else k for k in order_by]
    directed = any(re.search(r" (ASC|DESC) NULLS (FIRST|LAST)'>$", repr(k)) for k in keys)  # a direction isn't a value
    kinds = [None] if directed else [f.dataType for f in df.select(*keys).schema]
    if any(k is None or digit(F.lit(None), k) is None for k in kinds):
        ranked = with_row_index(df, order_by, index)
        return ranked.where(F.col(index).isin(sorted(wanted)))
    found = _found(df, keys, kinds, 0, 0, sorted(set(wanted)), 0, index, buckets, heavy)
    return reduce(DataFrame.unionAll, found) if found else df.limit(0).withColumn(index, F.lit(0).cast("long"))


def _found(df: DataFrame, keys: list[Column], kinds: list[T.DataType], depth: int, turn: int, wanted: list[int], offset: int, index: str, buckets: int, heavy: int) -> list[DataFrame]:
    """What holds the wanted places, part by part; ``offset`` rows come before ``df``."""
    x = digit(keys[0], kinds[0], depth)
    if turn % 2:  # a range that a few far values stretch is cut by its logarithm the second time
        x = F.signum(x) * F.log1p(F.abs(x))
    finite = F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
    facts = df.agg(F.min(finite).alias("low"), F.max(finite).alias("high")).first()
    low, high = (0.0, 0.0) if facts.low is None else (facts.low, facts.high)
    if high - low == float("inf"):  # wider than a double: halve the scale
        x, low, high = x / 4, low / 4, high / 4
    bucket = _buckets(x, low, high, buckets)
    counts = sorted(tuple(r) for r in df.groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).collect())  # as many as buckets
    starts, at = [], offset
    for _, n in counts:
        starts.append(at)
        at += n
    by_bucket: dict[int, list[int]] = {}
    for w in wanted:
        if offset <= w < at:
            by_bucket.setdefault(bisect_right(starts, w) - 1, []).append(w)
    out, light = [], {}
    for i, places in by_bucket.items():
        b, n = counts[i]
        if n <= heavy:
            light[b] = starts[i]
            continue
        inside = df.where(bucket == b)
        if turn < TURNS and high > low and 1 <= b <= buckets:  # the bucket's range may be cut again
            out += _found(inside, keys, kinds, depth, turn + 1, places, starts[i], index, buckets, heavy)
        elif isinstance(kinds[0], T.StringType) and b != 0 and not inside.where(F.length(keys[0].cast("binary")) > (depth + 1) * BYTES).isEmpty():
            out += _found(inside, keys, kinds, depth + 1, 0, places, starts[i], index, buckets, heavy)
        elif len(keys) > 1 and inside.select(keys[0]).distinct().limit(2).count() == 1:
            out += _found(inside, keys[1:], kinds[1:], 0, 0, places, starts[i], index, buckets, heavy)
        else:  # ties, or numbers that a double doesn't tell apart
            ranked = with_row_index(inside, keys, index).withColumn(index, F.col(index) + starts[i])
            out.append(ranked.where(F.col(index).isin(places)))
    if light:
        own = df.withColumn("__b", bucket).where(F.col("__b").isin(list(light)))
        start = F.element_at(F.lit(list(light.values())).cast("array<bigint>"), F.array_position(F.lit(list(light)).cast("array<int>"), F.col("__b")).cast("int"))
        place = F.row_number().over(Window.partitionBy("__b").orderBy(*keys)) - 1
        ranked = own.withColumn(index, start + place).drop("__b")
        out.append(ranked.where(F.col(index).isin([w for w in wanted if offset <= w < at])))
    return out
