"""Descriptive statistics, correlation and histograms. Functions ending in ``_sql`` are the SQL-flavoured variants."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coerce import equal_width_bin, num, safe_percent
from ..sources.scratch import kept
from .filters import Filter, apply_filters


def long_numbers(df: DataFrame, columns: Sequence[str], filters: Sequence[Filter] | None = None) -> DataFrame:
    """(column_name, x): one row for each number in the columns."""
    rows = apply_filters(df, filters)
    pairs = F.array(*(F.struct(F.lit(c).alias("column_name"), num(df, c).alias("x")) for c in columns))
    return rows.select(F.inline(pairs)).where("x is not null")


#: Relative rank error of the sketch that brackets a quantile, as its inverse.
ACCURACY = 10_000
#: Different values that a task puts in order for a quantile, and the pieces that more of them are cut into.
ORDERED, PIECES = 1_000_000, 200

QUARTILES = {"q1": 0.25, "q2": 0.5, "q3": 0.75}

#: A place among n sorted values, from 0, near a share of them.
Place = tuple[float, Callable[[Column], Column]]


def values_at(df: DataFrame, x: str, groups: Sequence[str], places: dict[str, Place], figures: Sequence[Column] = (), most: int = ORDERED) -> DataFrame:
    """For each group that has values, the exact values at places of its sorted values, and ``figures`` (aggregates) of them.

    Two passes over ``df``: the first takes the figures and a mergeable sketch, which brackets each place between two
    values; the second counts what lies below a bracket and keeps the values inside, a few ten-thousandths of all. While
    those are more than ``most`` in a group, they are cut into pieces and all but the piece that holds the place goes.
    """
    shares = sorted({share for share, _ in places.values()})
    e = 2.0 / ACCURACY
    cuts = [min(1.0, max(0.0, share + d)) for share in shares for d in (-e, e)]
    rows = df.where(F.col(x).isNotNull())
    by = [*groups] or [F.lit(0).alias("__all")]
    names = [*groups] or ["__all"]
    facts = kept(rows.groupBy(*by).agg(F.count(x).alias("__n"), F.percentile_approx(x, cuts, ACCURACY).alias("__b"), *figures), "brackets")
    # one row for each group
    joined = rows.select(*by, F.col(x).alias("__x")).join(F.broadcast(facts.select(*names, "__n", "__b")), names)
    few = F.col("__n") <= 10 * ACCURACY  # then a bracket is but a few values wide, and all may be put in order
    v, entries = F.col("__x"), []
    for i, share in enumerate(shares):
        low = F.lit(True) if share - e <= 0 else few | (v >= F.col("__b")[2 * i])
        high = F.lit(True) if share + e >= 1 else few | (v <= F.col("__b")[2 * i + 1])
        none = F.lit(None).cast(df.schema[x].dataType)
        entries.append(F.when(~low, F.struct(F.lit(i).alias("__i"), none.alias("__v"))).when(high, F.struct(F.lit(i).alias("__i"), v.alias("__v"))))
    spread = joined.select(*names, F.inline(F.array_compact(F.array(*entries))))
    # a null value stands for all that lie below
    inside = kept(spread.groupBy(*names, "__i", "__v").agg(F.count("*").alias("__c")), "inside")
    at = {name: F.greatest(F.lit(0), F.least(place(F.col("__n")).cast("long"), F.col("__n") - 1)) for name, (_, place) in places.items()}
    own = {name: F.col("__i") == shares.index(share) for name, (share, _) in places.items()}
    key = [*names, "__i"]
    while (inside.groupBy(*key).agg(F.count("__v").alias("k")).agg(F.max("k")).first()[0] or 0) > most:
        inside = kept(_piece(inside, facts, names, at, own), "inside")
    upto = F.sum("__c").over(Window.partitionBy(*key).orderBy(F.col("__v").asc_nulls_first()))
    placed = inside.withColumn("__upto", upto).join(F.broadcast(facts.select(*names, "__n")), names)
    hits = [F.max(F.when(own[name] & (F.col("__upto") > at[name]) & (F.col("__upto") - F.col("__c") <= at[name]), F.col("__v"))).alias(name) for name in places]
    found = placed.groupBy(*names).agg(*hits).join(F.broadcast(facts.drop("__b")), names)
    return found if groups else found.drop("__all")


def _piece(inside: DataFrame, facts: DataFrame, names: list[str], at: dict[str, Column], own: dict[str, Column]) -> DataFrame:
    """Of values with counts only the pieces from the first to the last that holds a place; what is below them is counted as such."""
    key = [*names, "__i"]
    cuts = inside.groupBy(*key).agg(F.percentile_approx("__v", [k / PIECES for k in range(1, PIECES)], ACCURACY).alias("__cuts"))
    cut = inside.join(F.broadcast(cuts), key).withColumn("__p", F.when(F.col("__v").isNull(), -1).otherwise(F.size(F.filter("__cuts", lambda c: c < F.col("__v"))))).drop("__cuts")
    sums = cut.groupBy(*key, "__p").agg(F.sum("__c").alias("__s"))  # as many as pieces
    upto = F.sum("__s").over(Window.partitionBy(*key).orderBy("__p"))
    sums = sums.withColumn("__upto", upto).join(F.broadcast(facts.select(*names, "__n")), names)
    holds = [own[name] & (F.col("__upto") > at[name]) & (F.col("__upto") - F.col("__s") <= at[name]) for name in at]
    ends = sums.where(reduce(lambda a, b: a | b, holds)).groupBy(*key).agg(F.min("__p").alias("__low"), F.max("__p").alias("__high"))
    left = cut.join(F.broadcast(ends), key).where("__p <= __high")
    return left.groupBy(*key, F.when(F.col("__p") >= F.col("__low"), F.col("__v")).alias("__v")).agg(F.sum("__c").alias("__c"))


def index_quantiles(x: str, groups: Sequence[str], df: DataFrame, points: dict[str, float], figures: Sequence[Column] = ()) -> DataFrame:
    """For each group the value at place floor(n * p) of its sorted values, from 0; and ``figures`` of them."""
    return values_at(df, x, groups, {name: (p, lambda n, p=p: F.floor(n * p)) for name, p in points.items()}, figures).drop("__n")


def interpolated_quantiles(x: str, groups: Sequence[str], df: DataFrame, points: dict[str, float], figures: Sequence[Column] = ()) -> DataFrame:
    """For each group the quantile between the values at the places around (n - 1) * p; and ``figures`` of its values."""
    places = {}
    for name, p in points.items():
        places[f"__{name}_low"] = (p, lambda n, p=p: F.floor((n - 1) * p))
        places[f"__{name}_high"] = (p, lambda n, p=p: F.ceil((n - 1) * p))
    found = values_at(df, x, groups, places, figures)
    part = lambda p: (F.col("__n") - 1) * p - F.floor((F.col("__n") - 1) * p)
    between = {n: F.col(f"__{n}_low") * (1 - part(p)) + F.col(f"__{n}_high") * part(p) for n, p in points.items()}
    return found.withColumns(between).drop("__n", *places)


def basic_stats(df: DataFrame, columns: Sequence[str], filters: Sequence[Filter] | None = None) -> DataFrame:
    """count, mean, population std, min, max, and quartiles by index, for each column that has numbers."""
    x = long_numbers(df, columns, filters)
    figures = [F.count("x").alias("count"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max")]
    return index_quantiles("x", ["column_name"], x, QUARTILES, figures).select("column_name", "count", "mean", "std", "min", "max", *QUARTILES)


def basic_stats_sql(df: DataFrame, columns: Sequence[str], filters: Sequence[Filter] | None = None) -> DataFrame:
    """As ``basic_stats``, with the sample std and interpolated quartiles."""
    x = long_numbers(df, columns, filters)
    figures = [F.count("x").alias("count"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max")]
    return interpolated_quantiles("x", ["column_name"], x, QUARTILES, figures).select("column_name", "count", "mean", "std", "min", "max", *QUARTILES)


def pearson(a: Column, b: Column) -> Column:
    """Correlation over rows that have both; 0 where one does not vary, null for fewer than two rows."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    return F.when(F.count(x) >= 2, F.coalesce(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)), F.lit(0.0)))


def strength(r: Column) -> Column:
    return F.when(F.abs(r) > 0.7, "strong").when(F.abs(r) > 0.3, "moderate").otherwise("weak")


def correlation_matrix(df: DataFrame, columns: Sequence[str], filters: Sequence[Filter] | None = None, keep_short: bool = False) -> DataFrame:
    """(column1, column2, correlation, strength) of all pairs, from a single aggregation."""
    pairs = list(combinations(columns, 2))
    rows = apply_filters(df, filters)
    wide = rows.agg(*(pearson(num(df, a), num(df, b)).alias(f"p{i}") for i, (a, b) in enumerate(pairs)))
    out = wide.select(F.inline(F.array(*(F.struct(F.lit(a).alias("column1"), F.lit(b).alias("column2"), F.col(f"p{i}").alias("correlation")) for i, (a, b) in enumerate(pairs)))))
    out = out.fillna(0.0, ["correlation"]) if keep_short else out.where("correlation is not null")
    return out.withColumn("strength", strength(F.col("correlation")))


def correlation_matrix_sql(df: DataFrame, columns: Sequence[str], filters: Sequence[Filter] | None = None) -> DataFrame:
    """As ``correlation_matrix``, with 0 also for pairs of too few rows."""
    return correlation_matrix(df, columns, filters, keep_short=True)


def histogram(df: DataFrame, column: str, bins: int = 10, filters: Sequence[Filter] | None = None) -> DataFrame:
    """All ``bins`` bins of equal width, the last one closed: bin, low, high, label, count, frequency (% with one decimal)."""
    x = apply_filters(df, filters).select(num(df, column).alias("x")).where("x is not null")
    facts = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n"))
    binned = x.crossJoin(F.broadcast(facts)).groupBy(equal_width_bin(F.col("x"), F.col("lo"), F.col("hi"), bins).alias("bin")).agg(F.count("*").alias("count"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).crossJoin(F.broadcast(facts)).where("n > 0").join(F.broadcast(binned), "bin", "left")
    width = (F.col("hi") - F.col("lo")) / bins
    low, high = F.col("lo") + F.col("bin") * width, F.col("lo") + (F.col("bin") + 1) * width
    count = F.coalesce("count", F.lit(0)).cast("long")
    return every.select("bin", low.alias("low"), high.alias("high"), F.format_string("%.1f-%.1f", low, high).alias("label"), count.alias("count"), F.format_string("%.1f", safe_percent(count, F.col("n"))).alias("frequency"))


def histogram_sql(df: DataFrame, column: str, bins: int = 20, filters: Sequence[Filter] | None = None) -> DataFrame:
    """Half-open bins: the maximum and empty bins are left out. bin, low, high, count, frequency (% of all rows)."""
    x = apply_filters(df, filters).select(num(df, column).alias("x")).where("x is not null")
    facts = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n"))
    width = (F.col("hi") - F.col("lo")) / bins
    placed = x.crossJoin(F.broadcast(facts)).where("x < hi").withColumn("bin", F.floor((F.col("x") - F.col("lo")) / width).cast("int"))
    out = placed.groupBy("bin", "lo", "hi", "n").agg(F.count("*").alias("count"))
    return out.select("bin", (F.col("lo") + F.col("bin") * width).alias("low"), (F.col("lo") + (F.col("bin") + 1) * width).alias("high"), "count", (F.col("count") * 100.0 / F.col("n")).alias("frequency"))
