"""A corpus from raw documents to packed sequences: each stage works on what the one before it kept.

In every stage a null text counts as an empty one, null ids and sources are values like others, repeated rows are rows,
columns beside those of documents are kept whatever their names are, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import exact_dedup, mixing, packing, simhash, toxicity
from sparkloom.llm._shared import RowStore, free_name, shared_path, writing


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier, fitted on ``labels``, rejects go; null and empty texts are scored like any other."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = free_name(docs, "toxicity")
    return toxicity.with_score(docs, model, name=name).where(F.col(name) < 0.5).drop(name)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints stays: the smallest doc_id (null last), then the first row of it."""
    store = RowStore(docs)
    text, doc_id = store.names["text"], store.names["doc_id"]
    groups = simhash.simhash_groups(store.rows.select("row", text), "row", text)
    of = groups.select("row", "component_id").join(store.rows.select("row", "part", F.col(doc_id).alias("id")), "row")
    first = of.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row", "part")).alias("x"))
    return store.select(first.select("x.row", "x.part"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come near their target weights: documents go, or are repeated up to three times."""
    return mixing.mixed_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed: copies of a document never share a sequence."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing", mix),
    ("packing", pack),
]

#: No SQL: a trained classifier and fingerprints of shingles are beyond it; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name.replace(' ', '-').lower()}")
        made = stage(spark, docs, sf_dir)
        with writing(spark):
            made.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
