"""Mutual information between columns."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import num
from ..sources.scratch import kept
from .filters import Filter, apply_filters


def _columns(pdf: pd.DataFrame, count: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Numbers (NaN where there is none), whether a value is there, and hashes of texts, by column."""
    x = np.stack([pdf[f"x{i}"].to_numpy(float, na_value=np.nan) for i in range(count)])
    full = np.stack([pdf[f"f{i}"].to_numpy(bool) for i in range(count)])
    return x, full, [pdf[f"h{i}"].to_numpy(np.int64) for i in range(count)]


def _facts(count: int):
    """Of each pair's rows: how many, and of either column the numbers, their least and their largest."""
    pairs = list(combinations(range(count), 2))

    def facts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        low, high = (np.full((count, count), v) for v in (np.inf, -np.inf))  # of the first column, in rows with both
        numbers, rows = np.zeros((count, count), np.int64), np.zeros((count, count), np.int64)
        for pdf in batches:
            if not len(pdf):
                continue
            x, full, _ = _columns(pdf, count)
            number = ~np.isnan(x) & full
            rows += full.astype(np.int64) @ full.T.astype(np.int64)
            numbers += number.astype(np.int64) @ full.T.astype(np.int64)
            for i in range(count):
                own = np.where(number[i] & full, x[i], np.nan)  # a row for each other column
                low[i] = np.fmin(low[i], np.fmin.reduce(own, 1))
                high[i] = np.fmax(high[i], np.fmax.reduce(own, 1))
        yield pd.DataFrame({"pair": range(len(pairs)), "n": [rows[p] for p in pairs], **{f"{k}{s}": [m[p if s == "a" else p[::-1]] for p in pairs] for s in "ab" for k, m in (("count", numbers), ("low", low), ("high", high))}})

    return facts


def _joint(count: int, facts: dict[int, tuple], bins: int):
    """(pair, u, v, c): counts of pairs of values in each batch; a text stands for its hash, a number among numbers for its bin."""
    pairs = list(combinations(range(count), 2))

    def joint(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x, full, hashes = _columns(pdf, count)
            coded = [np.unique(h, return_inverse=True) for h in hashes]
            out = []
            for pair, (n, ca, la, ha, cb, lb, hb) in facts.items():
                both = full[pairs[pair][0]] & full[pairs[pair][1]]
                sides = []
                for c, numbers, low, high in ((pairs[pair][0], ca, la, ha), (pairs[pair][1], cb, lb, hb)):
                    if numbers == n:
                        place = np.zeros(both.sum()) if high == low else np.minimum(np.floor((x[c][both] - low) / ((high - low) / bins)), bins - 1)
                        sides.append((np.arange(bins), place.astype(np.int64)))
                    else:
                        sides.append((coded[c][0], coded[c][1][both]))
                (us, i), (vs, j) = sides
                key = i * len(vs) + j
                if len(us) * len(vs) <= 1 << 16:
                    counts = np.bincount(key, minlength=1)
                    hit = np.flatnonzero(counts)
                    counts = counts[hit]
                else:
                    hit, counts = np.unique(key, return_counts=True)
                out.append(pd.DataFrame({"pair": pair, "u": us[hit // len(vs)], "v": vs[hit % len(vs)], "c": counts}))
            if out:
                yield pd.concat(out)

    return joint


def mutual_information(df: DataFrame, columns: Sequence[str], filters: Sequence[Filter] | None = None, bins: int = 10, normalization: str = "arithmetic") -> DataFrame:
    """(column1, column2, n, h1, h2, h12, mutual_information, h1_given_2, h2_given_1, normalized, relation), in bits.

    A pair's rows have both values, not blank; columns all of whose values are numbers are binned within the pair's rows;
    pairs of fewer than three rows are left out. All pairs are counted together: a batch of rows gives counts of pairs of
    codes, so neither rows nor texts are multiplied by the number of pairs. A text's code is its 64-bit hash.
    """
    spark, count = df.sparkSession, len(columns)
    rows, parts = apply_filters(df, filters), []
    for i, c in enumerate(columns):
        text = F.col(f"`{c}`").cast("string")
        parts += [num(df, c).cast("double").alias(f"x{i}"), F.coalesce(text != "", F.lit(False)).alias(f"f{i}"), F.xxhash64(text).alias(f"h{i}")]
    rows = rows.select(*parts)
    pairs = list(combinations(columns, 2))
    sides = ", ".join(f"count{s} long, low{s} double, high{s} double" for s in "ab")
    merged = [f(f"{k}{s}").alias(f"{k}{s}") for s in "ab" for k, f in (("count", F.sum), ("low", F.min), ("high", F.max))]
    # one row for each pair
    facts = {r.pair: (r.n, *(r[f"{k}{s}"] for s in "ab" for k in ("count", "low", "high"))) for r in rows.mapInPandas(_facts(count), f"pair int, n long, {sides}").groupBy("pair").agg(F.sum("n").alias("n"), *merged).where("n >= 3").collect()}
    sizes = spark.createDataFrame([(p, f[0]) for p, f in facts.items()], "pair int, n long")
    counted = rows.mapInPandas(_joint(count, facts, bins), "pair int, u long, v long, c long").groupBy("pair", "u", "v").agg(F.sum("c").alias("c"))
    joint = kept(counted.join(F.broadcast(sizes), "pair"), "joint")
    entropy = lambda c: -F.sum(c / F.col("n") * F.log2(c / F.col("n")))
    h12 = joint.groupBy("pair", "n").agg(entropy(F.col("c")).alias("h12"))
    one = lambda s, name: joint.groupBy("pair", "n", s).agg(F.sum("c").alias("c")).groupBy("pair", "n").agg(entropy(F.col("c")).alias(name)).drop("n")
    every = h12.join(one("u", "h1"), "pair").join(one("v", "h2"), "pair")
    names = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "pair int, column1 string, column2 string")
    mi = F.greatest(F.lit(0.0), F.col("h1") + F.col("h2") - F.col("h12"))
    scale = {"arithmetic": (F.col("h1") + F.col("h2")) / 2, "geometric": F.sqrt(F.col("h1") * F.col("h2")), "max": F.greatest("h1", "h2")}[normalization]
    out = every.join(F.broadcast(names), "pair").withColumn("mutual_information", mi).withColumn("normalized", F.coalesce(F.try_divide(mi, scale), F.lit(0.0)))
    relation = F.when(F.col("normalized") > 0.7, "Strong").when(F.col("normalized") > 0.3, "Moderate").when(F.col("normalized") > 0.1, "Weak").otherwise("Independent")
    return out.select("column1", "column2", "n", "h1", "h2", "h12", "mutual_information", (F.col("h12") - F.col("h2")).alias("h1_given_2"), (F.col("h12") - F.col("h1")).alias("h2_given_1"), "normalized", relation.alias("relation"))


def mutual_information_summary(pairs: DataFrame, threshold: float = 0.1) -> DataFrame:
    m = F.col("mutual_information")
    return pairs.agg(F.count("*").alias("pairs"), F.avg(m).alias("mean"), F.max(m).alias("max"), F.min(m).alias("min"), F.count_if(m > threshold).alias("strong"))
