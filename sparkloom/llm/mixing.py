"""Mixing sources to target weights with hash-threshold histograms, in DataFrame operations only.

Every document has a hash. A source that is to be taken m times gives floor(m) copies of all its documents and, for the
rest, those documents whose hash is below a threshold. The thresholds come from sums of words by source and hash bucket:
the bucket in which the budget runs out is summed again by the hash's next bits, and again, and nothing is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import missing_as_null, rows_of, staged, word_count

WEIGHTS = (5, 2, 1)
MOST = 3
#: Bits of the hash that each histogram looks at, and the number of histograms.
BITS, LEVELS = 10, 3


def _key(source: Column) -> Column:
    """A source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def _bucket(level: int) -> Column:
    return F.shiftrightunsigned("h", 64 - BITS * level)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(key, source_size, target) from (key, source_size): shares by weight, none above ``most`` times its size.

    Sharing the excess again and again ends at one level for all sources that are not full: a source gets the lesser of
    weight times level and its cap. In the order of cap over weight the level follows from running sums.
    """
    place = F.row_number().over(Window.orderBy(F.col("key") == "", "key"))
    weighted = sizes.withColumn("w", F.element_at(F.lit(list(weights)), (place - 1) % len(weights) + 1)).withColumn("cap", F.col("source_size") * float(most))
    order = Window.orderBy(F.col("cap") / F.col("w"), "key")
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    full = F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    open_w = F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0))
    level = (F.sum("source_size").over(whole) - full) / open_w
    levels = weighted.withColumn("level", level).withColumn("n", F.row_number().over(order))
    chosen = F.min_by(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level")), F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("n"))).over(whole)
    return levels.select("key", "source_size", F.least(F.coalesce(chosen, F.lit(0.0)) * F.col("w"), F.col("cap")).alias("target"))


def _thresholds(rows: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """(key, source_size, target, copies, cut, through): all documents ``copies`` times, and once more below the cut."""
    first = staged(rows.groupBy("key", _bucket(1).alias("b")).agg(F.sum("size").alias("n")), "histogram")
    targets = source_targets(first.groupBy("key").agg(F.sum("n").alias("source_size")), weights, most)
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-9)).otherwise(0).cast("long")
    plan = targets.withColumn("copies", copies).withColumn("left", F.greatest(F.lit(0.0), F.col("target") - F.col("copies") * F.col("source_size")))
    plan = staged(plan, "targets")
    cut, histogram = plan.select("key", "left"), first
    for level in range(1, LEVELS + 1):
        if level > 1:
            inside = rows.join(cut.select("key", "cut"), "key").where(_bucket(level - 1) == F.col("cut"))
            histogram = inside.groupBy("key", _bucket(level).alias("b")).agg(F.sum("size").alias("n"))
        running = F.sum("n").over(Window.partitionBy("key").orderBy("b"))
        crossing = histogram.withColumn("upto", running).join(cut.select("key", "left"), "key").where(F.col("upto") > F.col("left"))
        found = crossing.groupBy("key").agg(F.min_by(F.struct("b", "upto", "n"), "b").alias("x"))
        left = F.col("left") - (F.col("x.upto") - F.col("x.n"))
        cut = staged(cut.select("key", "left").join(found, "key").select("key", F.col("x.b").alias("cut"), left.alias("left"), F.col("x.n").alias("n")), "cut")
    # the last bucket is taken whole if that comes nearer to the budget
    nearest = cut.select("key", "cut", (F.col("n") - F.col("left") < F.col("left")).alias("through"))
    return staged(plan.join(nearest, "key", "left"), "thresholds")


def _copies() -> Column:
    at = _bucket(LEVELS)
    return F.col("copies") + F.when((at < F.col("cut")) | (F.col("through") & (at == F.col("cut"))), 1).otherwise(0)


def _measured(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    source = missing_as_null(docs, source_col, "string")
    return rows_of(docs, id=id_col, key=_key(source), size=word_count(F.col(f"`{text_col}`")), h=F.xxhash64(f"`{id_col}`", f"`{text_col}`"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """How much a mix takes of each row of ``docs``: ``id_col``, ``size``, ``source_size``, ``target``, ``taken``.

    ``size`` is the number of words. Sources, by code point with null last, weigh ``weights`` in turn and share 100 % of
    all words; no target is above ``most`` times its source's words, and what is over goes to the others by weight.
    Whole documents are taken, each at most ``most`` times, and a document with no words is taken for 0. Rows of equal id
    and text are taken alike. Null texts have size 0; the null source is a source; an empty table gives an empty result.
    Reruns agree: the hash of id and text decides. Other columns are ignored.
    """
    rows = staged(_measured(docs, id_col, text_col, source_col), "measured")
    joined = rows.join(_thresholds(rows, weights, most), "key")
    return joined.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * _copies()).cast("long").alias("taken"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The mix itself: each row of ``docs`` as many times as it is taken. Documents without words stay once."""
    rows = staged(_measured(docs, id_col, text_col, source_col), "measured")
    plain = [f"c{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, plain, strict=True))
    body = docs.toDF(*plain)
    source = F.col(at[source_col]) if source_col in at else F.lit(None).cast("string")
    body = body.withColumns({"key": _key(source), "h": F.xxhash64(at[id_col], at[text_col]), "size": word_count(F.col(at[text_col]))})
    taken = body.join(_thresholds(rows, weights, most), "key").withColumn("times", F.when(F.col("size") > 0, _copies()).otherwise(1).cast("int"))
    return taken.where("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*plain).toDF(*docs.columns)
