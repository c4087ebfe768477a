"""Runs of missing values, in row order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coerce import is_numeric_type, safe_percent, trim_text
from .ordering import CHUNK, with_row_index


def is_missing(v: Column, include_zero: bool = True, include_empty: bool = True, number: bool = False) -> Column:
    """Null; blank text if ``include_empty``; the number 0 or the text 0 if ``include_zero``. v: the value as text, or a ``number``."""
    out = v.isNull()
    if include_empty and not number:
        out = out | (trim_text(v) == "")
    if include_zero:
        out = out | F.coalesce(v == (0 if number else "0"), F.lit(False))
    return out


def missing_flags(df: DataFrame, columns: Sequence[str], order_by: Sequence[str], include_zero: bool = True, include_empty: bool = True, chunk: int = CHUNK) -> DataFrame:
    """(column_name, row_index, value, missing, valid_at, previous): the last valid row before each row, if any.

    Chunks of the index are worked on apart; what a chunk ends with is carried into the next ones.
    """
    indexed = with_row_index(df, order_by)
    kinds = {f.name: is_numeric_type(f.dataType) for f in df.schema}
    absent = {c: is_missing(F.col(f"`{c}`") if kinds[c] else F.col(f"`{c}`").cast("string"), include_zero, include_empty, kinds[c]) for c in columns}
    cells = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value"), absent[c].alias("missing")) for c in columns))
    long = indexed.select("row_index", F.inline(cells)).withColumn("chunk", F.floor(F.col("row_index") / chunk).cast("long"))
    valid = F.when(~F.col("missing"), F.struct(F.col("row_index").alias("at"), F.col("value").alias("v")))
    ends = long.groupBy("column_name", "chunk").agg(F.max(valid).alias("end"))
    carried = ends.withColumn("carry", F.max("end").over(Window.partitionBy("column_name").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))).drop("end")
    inside = Window.partitionBy("column_name", "chunk").orderBy("row_index").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(valid, ignorenulls=True).over(inside)
    placed = long.withColumn("own", before).join(carried, ["column_name", "chunk"], "left")
    last = F.coalesce("own", "carry")
    return placed.select("column_name", "row_index", "value", "missing", last["at"].alias("valid_at"), last["v"].alias("previous"))


def missing_events(flags: DataFrame) -> DataFrame:
    """(column_name, row_index, event, value, previous_value, length): a run's first row, and the first row after it.

    A run that lasts to the end has no end event.
    """
    i = F.col("row_index")
    since = i - F.coalesce(F.col("valid_at"), F.lit(-1)) - 1  # missing rows right before this one
    start, end = F.col("missing") & (since == 0), ~F.col("missing") & (since > 0)
    event = F.when(start, "missing_start").when(end, "missing_end")
    return flags.where(event.isNotNull()).select(
        "column_name", "row_index", event.alias("event"), "value", F.when(start, F.col("previous")).alias("previous_value"), F.when(end, since).cast("long").alias("length")
    )


def missing_stats(flags: DataFrame, reference_compat: bool = False) -> DataFrame:
    """(column_name, total, missing, runs, avg_length, max_length, missing_pct); ``reference_compat`` doubles avg_length."""
    i = F.col("row_index")
    since = i - F.coalesce(F.col("valid_at"), F.lit(-1)) - 1
    start = F.col("missing") & (since == 0)
    length = F.when(F.col("missing"), since + 1)
    out = flags.groupBy("column_name").agg(F.count("*").alias("total"), F.count_if("missing").alias("missing"), F.count_if(start).alias("runs"), F.coalesce(F.max(length), F.lit(0)).cast("long").alias("max_length"))
    mean = F.coalesce(F.try_divide(F.col("missing"), F.col("runs")), F.lit(0.0)) * (2 if reference_compat else 1)
    return out.select("column_name", "total", "missing", "runs", mean.alias("avg_length"), "max_length", safe_percent(F.col("missing"), F.col("total")).alias("missing_pct"))


def missing_summary(flags: DataFrame) -> DataFrame:
    """(columns, rows, missing, affected_columns, runs, missing_pct) over all columns."""
    s = missing_stats(flags)
    return s.agg(F.count("*").alias("columns"), F.max("total").alias("rows"), F.sum("missing").alias("missing"), F.count_if(F.col("missing") > 0).alias("affected_columns"), F.sum("runs").alias("runs"), safe_percent(F.sum("missing"), F.sum("total")).alias("missing_pct"))
