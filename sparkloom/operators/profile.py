"""Column profiles and type inference."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.coerce import num, parse_date, safe_percent, trim_text
from .filters import Filter, apply_filters
from .frequent import most_frequent

SAMPLE, SHARE = 100, 0.8
_FULL_DATES = r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}:\d{2})?|^\d{2}/\d{2}/\d{4}$|^\d{4}/\d{2}/\d{2}$|^\d{4}-\d{1,2}-\d{1,2}$|^\d{4}年\d{1,2}月\d{1,2}日( \d{1,2}時\d{1,2}分\d{1,2}秒)?$"


def _label(full: bool, c: Column) -> dict[str, Column]:
    text = c.cast("string")
    date = (text.rlike(_FULL_DATES) & parse_date(text).isNotNull()) if full else text.rlike(r"^\d{4}-\d{2}-\d{2}")
    return {"b": text.rlike("^(true|false)$"), "i": text.rlike(r"^-?\d+$"), "f": text.rlike(r"^-?\d*\.\d+$"), "d": date, "n": text.isNotNull() & (text != "")}


def infer_types(df: DataFrame, columns: Sequence[str], order_by: Sequence[str] = (), sample_rows: int | None = SAMPLE, full_dates: bool = True) -> DataFrame:
    """(column_name, inferred_type): INTEGER, FLOAT, NUMERIC, DATE, BOOLEAN or TEXT, if 80 % of the values look so.

    By default of the first 100 rows in the order of ``order_by``; ``sample_rows=None`` reads all. ``full_dates`` takes
    every known date form that also parses, else a leading ISO date is enough.
    """
    rows = df if sample_rows is None else (df.orderBy(*order_by) if order_by else df).limit(sample_rows)
    pairs = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("v")) for c in columns))
    tests = _label(full_dates, F.col("v"))
    found = rows.select(F.inline(pairs)).groupBy("column_name").agg(*(F.count_if(t).alias(k) for k, t in tests.items()))
    enough = lambda c: c >= F.col("n") * SHARE
    i, f, d, b = (F.col(x) for x in "ifdb")
    kind = F.when(F.col("n") == 0, "TEXT").when(enough(i), "INTEGER").when(enough(f), "FLOAT").when(enough(i + f), "NUMERIC").when(enough(d), "DATE").when(enough(b), "BOOLEAN").otherwise("TEXT")
    return found.select("column_name", kind.alias("inferred_type"))


def describe_table(df: DataFrame, order_by: Sequence[str] = ()) -> DataFrame:
    """(column_name, column_type, null): declared types, and for text what its values look like."""
    text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    declared = df.sparkSession.createDataFrame([(i, f.name, f.dataType.simpleString().upper(), "YES" if f.nullable else "NO") for i, f in enumerate(df.schema)], "i int, column_name string, declared string, null string")
    if not text:
        return declared.orderBy("i").select("column_name", F.col("declared").alias("column_type"), "null")
    return declared.join(infer_types(df, text, order_by), "column_name", "left").orderBy("i").select("column_name", F.coalesce("inferred_type", "declared").alias("column_type"), "null")


def eligible_columns(df: DataFrame, need: str) -> list[str]:
    """Columns that an analysis may use: ``numeric``, ``text``, ``date`` or ``all``; ``x`` also offers ``index``."""
    kinds = {"numeric": T.NumericType, "text": T.StringType, "date": (T.DateType, T.TimestampType, T.TimestampNTZType), "all": T.DataType, "x": (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)}
    return (["index"] if need == "x" else []) + [f.name for f in df.schema if isinstance(f.dataType, kinds[need])]


#: Fewest and most columns of each analysis.
ARITY = {
    "column": (1, None), "basic": (1, None), "correlation": (2, None), "changepoint": (1, 1), "factor": (2, None), "histogram": (1, 1),
    "timeseries": (1, 1), "missing": (1, None), "text": (1, 1), "association": (2, None), "mutual": (2, None), "canonical": (2, None),
}


def check_arity(analysis: str, columns: Sequence[str]) -> None:
    low, high = ARITY[analysis]
    if len(columns) < low or (high is not None and len(columns) > high):
        raise ValueError(f"{analysis} takes {low}{'' if high == low else f' to {high}' if high else ' or more'} columns, not {len(columns)}")


def column_profile(df: DataFrame, columns: Sequence[str], filters: Sequence[Filter] | None = None, order_by: Sequence[str] = ()) -> DataFrame:
    """One row for each column: counts and shares of null, blank and valid, distinct values, type, and numeric statistics.

    Distinct values are of trimmed text that isn't blank. Statistics are given if half of all values or more are numbers;
    the median is the value at place floor(n / 2).
    """
    from .stats import index_quantiles

    rows = apply_filters(df, filters)
    long = rows.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("v"), num(df, c).alias("x")) for c in columns))))
    clean = trim_text("v")
    plain = long.groupBy("column_name").agg(
        F.count("*").alias("total"), F.count_if(F.col("v").isNull()).alias("nulls"), F.count_if(clean == "").alias("blanks"), F.count_distinct(F.when(clean != "", clean)).alias("distinct"),
        F.count("x").alias("numbers"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"),
    )
    middle = index_quantiles("x", ["column_name"], long.where("x is not null"), {"median": 0.5})
    share = lambda c: safe_percent(F.col(c), F.col("total"))
    numeric = (F.col("numbers") > 0) & (F.col("numbers") >= F.col("total") * 0.5)
    out = plain.join(middle, "column_name", "left").join(infer_types(rows, columns, order_by, full_dates=False), "column_name", "left")
    return out.select(
        "column_name", "total", "nulls", share("nulls").alias("null_pct"), "blanks", share("blanks").alias("blank_pct"), F.greatest(F.lit(0.0), 100 - share("nulls") - share("blanks")).alias("valid_pct"),
        "distinct", F.coalesce("inferred_type", F.lit("TEXT")).alias("inferred_type"), *(F.when(numeric, F.col(c)).alias(c) for c in ("mean", "std", "min", "max", "median")),
    )


def profile_top_values(df: DataFrame, columns: Sequence[str], order_by: Sequence[str], k: int = 10) -> DataFrame:
    """(column_name, rank, value, count, pct) of each column's most frequent values, ties by first appearance."""
    first = F.struct(*order_by)
    long = df.select(first.alias("at"), F.inline(F.array(*(F.struct(F.lit(c).alias("column_name"), trim_text(F.col(f"`{c}`").cast("string")).alias("value")) for c in columns)))).where("value <> ''")
    return most_frequent(long, k).select("column_name", "rank", "value", "count", safe_percent(F.col("count"), F.col("n")).alias("pct"))


def profile_samples(df: DataFrame, columns: Sequence[str], order_by: Sequence[str], k: int = 10) -> DataFrame:
    """(column_name, rank, value): each column's first distinct values."""
    first = F.struct(*order_by)
    long = df.select(first.alias("at"), F.inline(F.array(*(F.struct(F.lit(c).alias("column_name"), trim_text(F.col(f"`{c}`").cast("string")).alias("value")) for c in columns)))).where("value <> ''")
    firsts = long.groupBy("column_name", "value").agg(F.min("at").alias("at"))
    return firsts.withColumn("rank", F.row_number().over(Window.partitionBy("column_name").orderBy("at"))).where(F.col("rank") <= k).select("column_name", "rank", "value")
