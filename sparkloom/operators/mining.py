"""Association rules between values of columns."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.coerce import size_band
from ..sources.scratch import kept
from .filters import Filter, apply_filters


def _items(df: DataFrame, columns: Sequence[str]) -> Column:
    """The sorted items ``column=value`` of a row: a boolean counts only if true, numbers by their band, null and blank text not at all."""
    items = []
    for c in columns:
        v, kind = F.col(f"`{c}`"), df.schema[c].dataType
        if isinstance(kind, T.BooleanType):
            items.append(F.when(v, F.lit(f"{c}=true")))
        elif isinstance(kind, T.NumericType):
            items.append(F.concat(F.lit(f"{c}="), size_band(v)))
        else:
            items.append(F.when(v.cast("string") != "", F.concat(F.lit(f"{c}="), v.cast("string"))))
    return F.array_sort(F.array_compact(F.array(*items)))


def item_counts(df: DataFrame, columns: Sequence[str], filters: Sequence[Filter] | None = None) -> DataFrame:
    """(item, count, share) of all items; the share is of the rows that have an item."""
    rows = apply_filters(df, filters).select(_items(df, columns).alias("items")).where(F.size("items") > 0)
    total = rows.agg(F.count("*").alias("total"))
    counted = rows.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("count"))
    return counted.crossJoin(F.broadcast(total)).select("item", "count", (F.col("count") / F.col("total")).alias("share"))


Itemset = tuple[int, ...]


def candidates(frequent: Iterable[Itemset]) -> list[Itemset]:
    """Sets one larger than the given ones, all of one size: two that differ in their last item alone are joined, and stay if every subset is among them."""
    known = set(frequent)
    by_prefix: dict[Itemset, list[int]] = {}
    for s in sorted(known):
        by_prefix.setdefault(s[:-1], []).append(s[-1])
    out = []
    for prefix, last in by_prefix.items():
        for a, b in combinations(last, 2):
            joined = (*prefix, a, b)
            if all(joined[:i] + joined[i + 1 :] in known for i in range(len(joined) - 2)):
                out.append(joined)
    return out


def _counts(sets: list[Itemset], items: int):
    """How many rows of a task hold each set: rows x items as a matrix, sets by what they share but for the last item."""
    by_prefix: dict[Itemset, list[int]] = {}
    for i, s in enumerate(sets):
        by_prefix.setdefault(s[:-1], []).append(i)
    lasts = {p: np.array([sets[i][-1] for i in own]) for p, own in by_prefix.items()}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = np.zeros(len(sets))
        for pdf in batches:
            held = np.zeros((len(pdf), items), np.float64)
            at = np.repeat(np.arange(len(pdf)), pdf["items"].map(len))
            held[at, np.concatenate([*pdf["items"], np.zeros(0, np.int64)]).astype(np.int64)] = 1
            n = pdf["n"].to_numpy(float)
            for prefix, own in by_prefix.items():
                some = np.flatnonzero(held[:, list(prefix)].all(1))
                if len(some):
                    found[own] += n[some] @ held[np.ix_(some, lasts[prefix])]
        hit = np.flatnonzero(found)
        yield pd.DataFrame({"set": hit, "count": found[hit].astype(np.int64)})

    return count


def frequent_itemsets(df: DataFrame, columns: Sequence[str], filters: Sequence[Filter] | None = None, min_support: float = 0.1, max_size: int = 3) -> DataFrame:
    """(items, size, count, support) of the sets of at most ``max_size`` items that a share ``min_support`` of rows have, level by level.

    A column has at most 1 / ``min_support`` frequent values, so the items, and the sets of a level, are bounded by the
    number of columns. Rows are reduced to their frequent items, as numbers, and counted once; each level counts only
    the sets whose every subset is frequent.
    """
    spark = df.sparkSession
    single = kept(item_counts(df, columns, filters), "items")
    first = single.agg(F.max(F.col("count") / F.col("share")).alias("n")).first().n
    total = round(first or 0)
    least = min_count(min_support, total)
    found = {(i,): r["count"] for i, r in enumerate(single.where(F.col("count") >= max(1, least)).orderBy("item").collect())}
    names = [r.item for r in single.where(F.col("count") >= max(1, least)).orderBy("item").select("item").collect()]
    number = F.create_map(*(x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i)))) if names else None
    if names and max_size > 1:
        known = F.filter(F.transform(_items(df, columns), lambda x: F.try_element_at(number, x)), lambda i: i.isNotNull())
        rows = apply_filters(df, filters).select(known.alias("items")).where(F.size("items") > 1)
        baskets = kept(rows.groupBy("items").agg(F.count("*").alias("n")), "baskets")
    level = list(found)
    for _ in range(1, max_size):
        sets = candidates(level)
        if not sets:
            break
        got = baskets.mapInPandas(_counts(sets, len(names)), "set long, count long").groupBy("set").agg(F.sum("count").alias("count")).where(F.col("count") >= max(1, least)).collect()
        level = [sets[r.set] for r in got]
        found |= {sets[r.set]: r["count"] for r in got}
    rows = [([names[i] for i in s], len(s), n, n / total) for s, n in found.items()]
    return spark.createDataFrame(rows, "items array<string>, size int, count long, support double")


def association_rules(itemsets: DataFrame, min_confidence: float = 0.5) -> DataFrame:
    """(antecedent, consequent, support, confidence, lift, conviction, strength) of all proper subsets of the itemsets."""
    n = F.size("items")
    masks = F.sequence(F.lit(1), (F.pow(F.lit(2), n) - 2).cast("int"))
    side = lambda m, want: F.filter("items", lambda x, i: (F.shiftright(m, 0).bitwiseAND(F.element_at(F.lit([1 << k for k in range(20)]), i + 1)) != 0) == want)
    split = itemsets.where(n > 1).select("items", "support", F.explode(masks).alias("m")).select("support", side(F.col("m"), True).alias("antecedent"), side(F.col("m"), False).alias("consequent"))
    known = itemsets.select(F.col("items"), F.col("support").alias("s"))
    joined = split.join(known.select(F.col("items").alias("antecedent"), F.col("s").alias("sa")), "antecedent").join(known.select(F.col("items").alias("consequent"), F.col("s").alias("sc")), "consequent")
    confidence = F.col("support") / F.col("sa")
    rules = joined.withColumn("confidence", confidence).where(F.col("confidence") >= min_confidence)
    lift, conviction = F.coalesce(F.try_divide(F.col("confidence"), F.col("sc")), F.lit(0.0)), F.coalesce(F.try_divide(1 - F.col("sc"), 1 - F.col("confidence")), F.lit(0.0))
    strength = F.when((F.col("confidence") >= 0.8) & (lift >= 1.5), "strong").when((F.col("confidence") >= 0.6) & (lift >= 1.0), "moderate").otherwise("weak")
    return rules.select("antecedent", "consequent", "support", "confidence", lift.alias("lift"), conviction.alias("conviction"), strength.alias("strength"))


def min_count(support: float, total: int) -> int:
    return math.ceil(support * total)
