"""Row order as data: global row indices and neighbourhoods without one big sort partition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import scratch_path

#: Rows of a series that one task orders.
CHUNK = 1_000_000


def with_row_index(df: DataFrame, order_by: Sequence[str | Column], name: str = "row_index") -> DataFrame:
    """Each row's position from 0 in the order of ``order_by``.

    The rows are sorted over all partitions and written once to the shared folder; one number for each partition is brought together, and a row's index is
    its partition's offset plus its place in there.
    """
    placed = df.orderBy(*order_by).withColumn("__at", F.monotonically_increasing_id())
    path = scratch_path(df.sparkSession, "ordered")
    placed.write.parquet(path)  # rows that tie keep the places that they have got, whatever is lost later
    placed = df.sparkSession.read.schema(placed.schema).parquet(path)
    sizes = dict(placed.groupBy(F.shiftright("__at", 33).cast("int").alias("p")).count().collect())
    offsets = [0]
    for p in range(max(sizes, default=-1)):
        offsets.append(offsets[-1] + sizes.get(p, 0))
    start = F.element_at(F.lit(offsets).cast("array<bigint>"), (F.shiftright("__at", 33) + 1).cast("int"))
    return placed.withColumn(name, start + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__at")


def with_halo(df: DataFrame, before: int, after: int = 0, index: str = "row_index", chunk: int = CHUNK) -> DataFrame:
    """Rows by ``chunk`` of the index, each chunk with copies of its neighbours' edge rows (``own`` is false for those).

    A window partitioned by ``chunk`` and ordered by the index then sees what it needs for frames of that many rows.
    """
    i = F.col(index)
    base = F.floor(i / chunk).cast("long")
    into = [base]
    if before:
        into.append(F.when(i % chunk >= chunk - before, base + 1))
    if after:
        into.append(F.when((i % chunk < after) & (base > 0), base - 1))
    spread = df.withColumn("chunk", F.explode(F.array_compact(F.array(*into))))
    return spread.withColumn("own", F.col("chunk") == base)
