"""What several operators of this subpackage need: tables in the shared folder, a row store, whitespace tokens."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters that are neither a space nor one of the control characters from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"

_written: list[tuple[SparkSession, str]] = []
_tables: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or, on a local master only, a folder of our own where that is unset."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        there = tempfile.mkdtemp(prefix="sparkloom-")
        spark.sparkContext.setCheckpointDir(there)
    return there.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


#: Rows that go to Python at once where they carry whole texts.
TEXTS_AT_ONCE = 1000


@contextlib.contextmanager
def writing(spark: SparkSession, rows: int = TEXTS_AT_ONCE):
    """For jobs that write a table: ``rows`` rows at once go to Python, few where rows are large, and shuffle files go when the job is done."""
    own = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def staged(df: DataFrame, name: str, by: str | None = None, rows: int = TEXTS_AT_ONCE) -> DataFrame:
    """``df`` as written to the shared folder, partitioned ``by`` a column: lineage ends here, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    with writing(spark, rows):
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged() -> None:
    """Remove every table that this driver has staged. Results that still read them must have been written before."""
    while _tables:
        spark, table = _tables.pop()
        with contextlib.suppress(Exception):  # the session has ended, and its catalog with it
            spark.sql(f"DROP TABLE IF EXISTS {table}")
    while _written:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session has ended; its folder goes with it
            return


atexit.register(drop_staged)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text: Column) -> Column:
    """Number of words in a text, 0 for null. Word starts are counted on the text without the rest of each word."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def rows_of(df: DataFrame, **columns: Column | str) -> DataFrame:
    """Only the named columns, under names of our own, so that no other column of ``df`` can clash."""
    return df.select(*((F.col(f"`{c}`") if isinstance(c, str) else c).alias(k) for k, c in columns.items()))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores after it until no column of ``df`` is called so."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def missing_as_null(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(f"`{name}`") if name in df.columns else F.lit(None).cast(kind)


def in_fold(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves ``remainder``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus == remainder


def bounded(df: DataFrame, most: int, *keys: Column) -> DataFrame:
    """The ``most`` rows that come first in the order of a hash of ``keys``: the same rows at every run."""
    return df.orderBy(F.xxhash64(*keys), *keys).limit(most)


def even_keys(spark: SparkSession, n: int) -> list[int]:
    """For each of n buckets a number that Spark's bucketing by a bigint column puts there."""
    found: dict[int, int] = {}
    start, step = 0, 16 * n + 64
    while len(found) < n:
        for b, k in spark.range(start, start + step, 1, 1).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("b")).agg(F.min("id")).collect():
            found.setdefault(b, k)
        start += step
    return [found[b] for b in range(n)]


def bucketed(df: DataFrame, name: str, by: str, n: int) -> DataFrame:
    """``df`` as a table in the shared folder, in n buckets by a bigint column: joins and groups by it need no shuffle."""
    table = f"{name}_{uuid.uuid4().hex}"
    with writing(df.sparkSession):
        df.write.bucketBy(n, by).option("path", shared_path(df.sparkSession, name)).saveAsTable(table)
    _tables.append((df.sparkSession, table))
    return df.sparkSession.table(table)


class RowStore:
    """A DataFrame's rows written once, bucketed by the task that wrote them, and then addressed by row id.

    ``row`` is a row's unique id. Decisions about rows come back as a bitmap for each writing task, and ``select``
    applies them bucket by bucket: the texts are read again but never shuffled.
    """

    def __init__(self, df: DataFrame, **added: Column):
        spark = self.spark = df.sparkSession
        self.columns = df.columns
        n = partitions(spark)
        keys = even_keys(spark, n)
        plain = [f"c{i}" for i in range(len(df.columns))]
        body = df.toDF(*plain)
        names = dict(zip(df.columns, plain, strict=True))
        extra = {k: v(lambda c: F.col(names[c])) for k, v in added.items()}
        body = body.select(*plain, *(v.alias(k) for k, v in extra.items()), F.monotonically_increasing_id().alias("row"))
        body = body.withColumn("part", F.element_at(F.lit(keys), (F.shiftright("row", 33) % n + 1).cast("int")).cast("long"))
        self.plain, self.names = plain, names
        self.rows = bucketed(body, "rows", "part", n)

    def flagged(self, flags: DataFrame) -> DataFrame:
        """All rows with ``flag``; flags: (part, tasks array<long>, bitmaps array<binary>), at most one row for a part."""
        bits = flags.select("part", F.map_from_arrays("tasks", "bitmaps").alias("bits")).hint("shuffle_hash")
        at = F.col("row").bitwiseAND(F.lit((1 << 33) - 1))
        bitmap = F.try_element_at("bits", F.shiftright("row", 33))
        byte = F.conv(F.hex(F.substring(bitmap, (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        return self.rows.join(bits, "part", "left").withColumn("flag", F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))).drop("bits")

    def select(self, ids: DataFrame) -> DataFrame:
        """The stored rows, in their own columns, whose row id is in ``ids`` (row, part)."""
        flags = ids.select("part", "row").groupBy("part").applyInPandas(_as_bitmaps, "part long, tasks array<long>, bitmaps array<binary>")
        kept = self.flagged(flags).where("flag")
        return kept.select(*(F.col(p) for p in self.plain)).toDF(*self.columns)


def release_memory() -> None:
    """Give what a Python worker has freed back to the system; a worker lives on after its largest piece of work."""
    import ctypes

    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def bitmaps(rows: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Row ids as a bitmap for each writing task; bit i of a task's bitmap stands for its row i."""
    tasks, maps = [], []
    for task in np.unique(rows >> 33):
        own = rows[rows >> 33 == task] & ((1 << 33) - 1)
        bits = np.zeros((int(own.max()) // 8 + 1) * 8, np.uint8)
        bits[own] = 1
        tasks.append(int(task))
        maps.append(np.packbits(bits, bitorder="little").tobytes())
    return tasks, maps


def _as_bitmaps(pdf):
    import pandas as pd

    tasks, maps = bitmaps(pdf["row"].to_numpy(np.int64))
    return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "tasks": [tasks], "bitmaps": [maps]})
