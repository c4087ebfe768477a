"""Looking at a table: counts, sorted pages, first and most frequent values."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.coerce import num, parse_date
from .filters import Filter, apply_filters
from .frequent import most_frequent

PAGE_SIZES = (5, 10, 25, 50, 100)


def sort_key(df: DataFrame, column: str, kind: str | None = None) -> Column:
    """What a column sorts by: text as dates or numbers if ``kind`` says so, else by the language's order."""
    if kind == "DATE" and isinstance(df.schema[column].dataType, T.StringType):
        return parse_date(column)
    if kind in ("INTEGER", "FLOAT", "NUMERIC", "DOUBLE", "NUMBER"):
        return num(df, column)
    c = F.col(f"`{column}`")
    return F.collate(c, "UNICODE") if kind == "LOCALE" else c


def sort_rows(df: DataFrame, column: str, descending: bool = False, kind: str | None = None, then: Sequence[str] = (), nulls: str = "preview") -> DataFrame:
    """Nulls come first going up and last going down; in result tables (``nulls='result'``) the other way round."""
    key = sort_key(df, column, kind)
    up_first = nulls == "preview"
    order = (key.desc_nulls_last() if up_first else key.desc_nulls_first()) if descending else (key.asc_nulls_first() if up_first else key.asc_nulls_last())
    return df.orderBy(order, *then)


def page(df: DataFrame, number: int, size: int = 10) -> DataFrame:
    """Page ``number`` from 1 of a sorted DataFrame."""
    return df.offset((number - 1) * size).limit(size)


def page_count(rows: int, size: int) -> int:
    return math.ceil(rows / size)


def counts(df: DataFrame, filters: Sequence[Filter]) -> DataFrame:
    """(total, filtered) in one pass."""
    from .filters import compile_filters

    return df.agg(F.count("*").alias("total"), F.count_if(compile_filters(filters, df.schema)).alias("filtered"))


def preview(df: DataFrame, filters: Sequence[Filter] = (), sort: str | None = None, descending: bool = False, number: int = 1, size: int = 10, kind: str | None = None, then: Sequence[str] = ()) -> DataFrame:
    rows = apply_filters(df, filters)
    return page(sort_rows(rows, sort, descending, kind, then) if sort else rows, number, size)


def top_values(df: DataFrame, column: str, order_by: Sequence[str], k: int = 10) -> DataFrame:
    """The ``k`` most frequent values; ties by first appearance in the order of ``order_by``."""
    value = F.col(f"`{column}`")
    long = df.where(value.isNotNull()).select(F.lit(column).alias("column_name"), value.alias("value"), F.struct(*order_by).alias("at"))
    return most_frequent(long, k).orderBy("rank").select("value", "count")


def first_values(df: DataFrame, column: str, order_by: Sequence[str], k: int = 10) -> DataFrame:
    """The first ``k`` distinct values in the order of ``order_by``."""
    first = F.min(F.struct(*order_by)).alias("__first")
    return df.where(F.col(f"`{column}`").isNotNull()).groupBy(F.col(f"`{column}`").alias("value")).agg(first).orderBy("__first").limit(k).drop("__first")
