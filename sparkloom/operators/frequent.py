"""The most frequent values, exactly, without a count of every value.

A mergeable summary of hashes (frequent items: as many counters as a parameter says) names candidates and bounds how often
any other value can occur. The candidates' rows are then counted exactly. If the k-th of these counts is above the bound,
no value is missing; else, and only for the columns where it isn't, all values are counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import kept

#: Counters of a summary, and candidates that are counted exactly.
TRACKED, CANDIDATES = 10_000, 1000
#: A summary of m counters errs by at most this share of the rows, divided by m.
ERROR = 3.5


def most_frequent(long: DataFrame, k: int, tracked: int = TRACKED, candidates: int = CANDIDATES) -> DataFrame:
    """(column_name, value, count, at, rank, n): each column's ``k`` most frequent values, ties by least ``at``; n: its rows.

    long: (column_name, value, at), values not null.
    """
    spark = long.sparkSession
    rows = long.withColumn("h", F.xxhash64("value"))
    # one row for each column
    summary = rows.groupBy("column_name").agg(F.count("*").alias("n"), F.expr(f"approx_top_k(h, {candidates}, {tracked})").alias("top")).collect()
    named = [(r.column_name, x.item) for r in summary for x in r.top]
    bound = {}
    for r in summary:
        whole = sum(x["count"] for x in r.top) == r.n  # then every value is among the candidates
        least = r.top[-1]["count"] if len(r.top) >= candidates else 0
        bound[r.column_name] = -1 if whole else max(least, ERROR * r.n / tracked)
    wanted = spark.createDataFrame(named, "column_name string, h long")
    best = Window.partitionBy("column_name").orderBy(F.desc("count"), "at")
    exact = rows.join(F.broadcast(wanted), ["column_name", "h"]).groupBy("column_name", "value").agg(F.count("*").alias("count"), F.min("at").alias("at"))
    ranked = kept(exact.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), "frequent")
    last = {r.column_name: (r.k, r.least) for r in ranked.groupBy("column_name").agg(F.count("*").alias("k"), F.min("count").alias("least")).collect()}
    sure = [c for c, b in bound.items() if b < 0 or last.get(c, (0, 0))[0] == k and last[c][1] > b]
    rest = [c for c in bound if c not in sure]
    out = ranked.where(F.col("column_name").isin(sure))
    if rest:
        counted = long.where(F.col("column_name").isin(rest)).groupBy("column_name", "value").agg(F.count("*").alias("count"), F.min("at").alias("at"))
        out = out.unionByName(counted.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k))
    totals = spark.createDataFrame([(r.column_name, r.n) for r in summary], "column_name string, n long")
    return out.join(F.broadcast(totals), "column_name")
