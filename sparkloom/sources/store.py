"""Tables that live as Parquet folders, and small texts, in any store that Spark reaches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def file_system(spark: SparkSession, path: str):
    """(store, path) as Hadoop has them."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text; what was there stays until the new one is whole."""
    store, at = file_system(spark, path)
    fresh = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = store.create(fresh)
    out.write(bytearray(text.encode()))
    out.close()
    store.delete(at, False)
    if not store.rename(fresh, at):
        raise OSError(f"{path} could not be written")


def read_text(spark: SparkSession, path: str) -> str | None:
    store, at = file_system(spark, path)
    if not store.exists(at):
        return None
    stream = store.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def exists(spark: SparkSession, path: str) -> bool:
    store, at = file_system(spark, path)
    return store.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    store, at = file_system(spark, path)
    store.delete(at, True)


def widened(schema: T.StructType, other: T.StructType) -> T.StructType:
    """A schema with the other's further columns after its own; names differ by more than case."""
    known = {f.name.lower() for f in schema}
    return T.StructType([*schema, *(T.StructField(f.name, f.dataType) for f in other if f.name.lower() not in known)])


class StoredTable:
    """A Parquet folder that rows are appended to. Reading it is one scan, however often rows were added."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | None = None):
        self.spark, self.path, self.schema = spark, path, schema

    def append(self, rows: DataFrame) -> None:
        """Add rows: columns that they lack are null, further ones are new to the table, others take the table's types."""
        own = self.schema or T.StructType([])
        schema = widened(own, rows.schema)
        kinds = {f.name.lower(): f.dataType for f in own}
        cast = rows.select(*(F.col(f"`{f.name}`").cast(kinds.get(f.name.lower(), f.dataType)).alias(f.name) for f in rows.schema))
        cast.write.mode("append").parquet(self.path)
        self.schema = schema

    def frame(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def compact(self, files: int = 1) -> None:
        """The same rows in fewer files: written beside the folder, which then takes its place."""
        fresh = f"{self.path}-{uuid.uuid4().hex}"
        self.frame().coalesce(files).write.parquet(fresh)
        delete(self.spark, self.path)
        store, at = file_system(self.spark, fresh)
        store.rename(at, self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path))
        self.spark.catalog.refreshByPath(self.path)
