"""Reading files of any accepted kind as tables."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.coerce import has_text, trim_text
from . import encoding as enc
from .json_document import elements
from .scratch import kept

EXTENSIONS = ("csv", "tsv", "txt", "json", "sqlite", "sqlite3", "db", "duckdb", "parquet")


def extension(path: str) -> str:
    return path.rstrip("/").rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""


def is_accepted(path: str) -> bool:
    return extension(path) in EXTENSIONS


def base_name(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[0] if "." in name else name


def clean_column(name: str, place: int = 0) -> str:
    """Quotes, semicolons, backslashes and white space become single underscores; an empty name gets one by its place."""
    out = re.sub(r"_+", "_", re.sub(r"['\"`;\\\r\n\t]|\s+", "_", name.strip())).strip("_")
    return out or f"column_{place}"


def clean_table(name: str) -> str:
    """A table name of 63 characters at most; longer ones end in a hash of the whole."""
    out = re.sub(r"_+", "_", re.sub(r'["\r\n\t]|\s+', "_", name.strip()))
    out = f"t_{out}" if out[:1].isdigit() else out or "data"
    return out if len(out) <= 63 else f"{out[:54]}_{hashlib.sha256(out.encode()).hexdigest()[:8]}"


def head(spark: SparkSession, path: str, n: int = enc.PROBE) -> bytes:
    """A file's first bytes (of a folder's first file), from any store that Spark reads, without the rest of it."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(conf)
    found = store.globStatus(at) or []
    if found and found[0].isDirectory():
        found = sorted((f for f in store.listStatus(found[0].getPath()) if not f.isDirectory() and f.getPath().getName()[0] not in "._"), key=lambda f: f.getPath().getName())
    if not found:
        return b""
    stream = store.open(found[0].getPath())
    try:
        return bytes(stream.readNBytes(n))
    finally:
        stream.close()


def _tidy(df: DataFrame) -> DataFrame:
    names = [clean_column(c, i) for i, c in enumerate(df.columns)]
    seen: dict[str, int] = {}
    for i, n in enumerate(names):
        seen[n] = seen.get(n, 0) + 1
        names[i] = n if seen[n] == 1 else f"{n}_{seen[n]}"
    df = df.toDF(*names)
    blank = F.lit(None).cast("string")
    return df.select(*(F.when(trim_text(c) != "", trim_text(c)).otherwise(blank).alias(c) for c in names))


def read_csv(spark: SparkSession, path: str, sep: str = ",", encoding: str | None = None, multi_line: bool = False) -> DataFrame:
    """All columns as text, cells trimmed, empty ones null, short rows filled up, extra cells and blank lines dropped."""
    encoding = enc.normalize(encoding) if encoding else enc.detect(head(spark, path)).encoding
    options = {"header": True, "sep": sep, "escape": '"', "nullValue": "", "emptyValue": "", "multiLine": multi_line, "mode": "PERMISSIVE", "enforceSchema": True}
    if encoding == "utf-8":
        df = spark.read.options(**options).csv(path)
    elif encoding in enc.NATIVE:
        df = spark.read.options(**options | {"multiLine": True, "encoding": enc.NATIVE[encoding]}).csv(path)
    else:
        lines = decoded_lines(spark, path, encoding)
        heads = lines.where(has_text("value")).groupBy("path").agg(F.min(F.struct("at", "value")).alias("head"))  # one for each file
        first = heads.orderBy("path").first()
        if first is None:
            raise ValueError(f"{path} is empty")
        first = first.head.value
        names = spark.createDataFrame([(first,)], "value string").select(F.from_csv("value", _wide(first.count(sep) + 1), {"sep": sep, "escape": '"'}).alias("r")).select("r.*").first()
        width = len([n for n in names if n is not None])
        body = lines.join(F.broadcast(heads), "path").where(has_text("value") & (F.col("at") > F.col("head.at"))).select(F.from_csv("value", _wide(width), {"sep": sep, "escape": '"'}).alias("r"))
        df = body.select("r.*").toDF(*(names[i] for i in range(width)))
    if not df.columns:
        raise ValueError(f"{path} is empty")
    return _tidy(df)


def read_csv_auto(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A CSV file with a header, each column of the type that fits all of its values."""
    found = spark.read.options(header=True, sep=sep, escape='"', inferSchema=True, enforceSchema=False).csv(path)
    return found.toDF(*(clean_column(c, i) for i, c in enumerate(found.columns)))


def _wide(n: int) -> str:
    return ", ".join(f"c{i} string" for i in range(n))


def decoded_lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """(path, at, value): the lines of files in an encoding that Spark's readers don't take, in ranges of any number.

    ``at`` orders a file's lines. Spark cuts at bytes 10 and 13, which in these encodings are never part of a longer
    character, and at which shift states end; so a line can be decoded by itself, wherever its range begins. The reader
    passes bytes on as they are.
    """

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(value=[enc.decode(bytes(v), encoding) for v in pdf["value"]])

    flat = raw_lines(spark, path).mapInPandas(lines, "path string, block long, n long, value string")
    return flat.select("path", F.struct("block", "n").alias("at"), "value")


def raw_lines(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """(path, block, n, value): lines as bytes, with the start of the range that they were read in and their order there."""
    reader = spark.read.option("lineSep", sep) if sep else spark.read
    return reader.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), F.col("value").cast("binary").alias("value"))


def read_tsv(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_csv(spark, path, "\t", **options)


def read_json(spark: SparkSession, path: str, encoding: str | None = None, at: str | None = None, parts: bool = False) -> DataFrame:
    """An array of objects or one object: keys as columns in the order of first appearance, scalars as text, the rest as JSON.

    The document is cut at its elements in ranges, so it may be of any size; an element must fit in a task. Elements
    that are no objects give rows of nulls. A ValueError says if a document isn't valid JSON, or holds no rows or no keys.
    Keys that are whole numbers come first in their object, in their order, as in JSON itself for many readers. ``at``
    names a column that orders rows as they stand in the document. With ``parts`` the files of a folder, by name, are one
    document, of which each file ends between two elements; otherwise each file is one.
    """
    encoding = enc.normalize(encoding) if encoding else enc.detect(head(spark, path)).encoding
    if encoding.startswith("utf-16"):
        if parts:
            raise ValueError("a document in UTF-16 is read from one file")
        rows = spark.read.option("multiLine", True).option("singleVariantColumn", "v").json(path)
        text = rows.select(F.explode(F.when(F.schema_of_variant("v").startswith("ARRAY"), F.expr("variant_get(v, '$', 'array<variant>')")).otherwise(F.array("v"))).alias("v")).select(F.to_json("v").alias("text"))
        rows = text.withColumns({"path": F.lit(""), "block": F.spark_partition_id().cast("long"), "i": F.monotonically_increasing_id()})
    else:
        rows = elements(raw_lines(spark, path, "\n" if encoding == "iso2022_jp" else ","), "\n" if encoding == "iso2022_jp" else ",", encoding, parts)
    rows = kept(rows, "elements")
    parsed = F.try_parse_json("text")
    facts = rows.agg(F.count("*").alias("n"), F.count_if(parsed.isNull()).alias("bad")).first()
    if facts.bad:
        raise ValueError(f"{path} is no valid JSON: {facts.bad} of its elements can't be parsed")
    if not facts.n:
        raise ValueError(f"{path} holds no rows")
    named = rows.select("path", "block", "i", F.posexplode(F.json_object_keys("text")).alias("pos", "k"))
    number = F.when(F.col("k").rlike(r"^(0|[1-9]\d{0,8})$"), F.col("k").cast("long"))
    # a place in its block as one number, which is aggregated by hashing; a least struct would have all keys of all rows sorted
    place = F.col("i").cast("decimal(19,0)") * F.lit(2**33).cast("decimal(10,0)") + number.isNull().cast("long") * F.lit(2**32) + F.coalesce(number, F.col("pos").cast("long"))
    of_block = named.groupBy("path", "block", "k").agg(F.min(place).alias("place"))
    keys = [r.k for r in of_block.groupBy("k").agg(F.min(F.struct("path", "block", "place")).alias("first")).orderBy("first").collect()]  # as many as there are columns
    if not keys:
        raise ValueError(f"{path} holds no objects with keys")
    raw = F.from_json("text", "map<string,string>")
    values = rows.select(parsed.alias("v"), raw.alias("raw"), F.struct("path", "block", "i").alias("at"))

    def value(k: str):
        place = f"$['{k}']" if "'" not in k else f'$["{k}"]'
        nested = F.schema_of_variant(F.try_variant_get("v", place, "variant")).rlike("^(OBJECT|ARRAY)<")
        return F.when(F.coalesce(nested, F.lit(False)), F.element_at("raw", k)).otherwise(F.try_variant_get("v", place, "string"))

    names, seen = [clean_column(k, i) for i, k in enumerate(keys)], {}
    for i, n in enumerate(names):
        seen[n.lower()] = seen.get(n.lower(), 0) + 1
        names[i] = n if seen[n.lower()] == 1 else f"{n}_{seen[n.lower()]}"
    return values.select(*(value(k).alias(n) for k, n in zip(keys, names, strict=True)), *([F.col("at").alias(at)] if at else []))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def database_kind(data: bytes) -> str:
    """``sqlite``, ``duckdb`` or ``unknown`` by a file's first bytes."""
    return "sqlite" if data.startswith(b"SQLite format 3\0") else "duckdb" if data[8:12] == b"DUCK" else "unknown"


def _is_object(c: str):
    v = F.col(f"`{c}`")
    return F.coalesce(F.from_json(v, "map<string,string>").isNotNull() & F.ltrim(v).startswith("{"), F.lit(False))


def columns_of_objects(df: DataFrame, columns: list[str], order_by: list[str], probe: int = 100, share: float = 0.3) -> list[str]:
    """The text columns of which at least a ``share`` of the first rows that aren't null are JSON objects."""
    if not columns:
        return []
    aggs = [x for i, c in enumerate(columns) for x in (F.count(F.col(f"`{c}`")).alias(f"n{i}"), F.count_if(_is_object(c)).alias(f"k{i}"))]
    seen = df.select(*order_by, *(F.col(f"`{c}`") for c in columns)).orderBy(*order_by).limit(probe).agg(*aggs).first()
    return [c for i, c in enumerate(columns) if seen[f"n{i}"] and seen[f"k{i}"] >= share * seen[f"n{i}"]]


def json_child_table(df: DataFrame, table: str, column: str, order_by: list[str], probe: int = 100, share: float = 0.3) -> DataFrame | None:
    """The objects in a text column of JSON as a table of their own, or None if too few of the first rows hold one.

    Keys become typed columns; ``_source_row_id`` counts rows from 1 in the order of ``order_by``.
    """
    return _child(df, table, column, order_by) if columns_of_objects(df, [column], order_by, probe, share) else None


def _child(df: DataFrame, table: str, column: str, order_by: list[str]) -> DataFrame:
    from ..operators.ordering import with_row_index

    c = F.col(f"`{column}`")
    schema = df.where(_is_object(column)).agg(F.schema_of_variant_agg(F.try_parse_json(c))).first()[0].replace("OBJECT<", "STRUCT<").replace("VOID", "STRING")
    rows = with_row_index(df.select(*order_by, c), order_by).where(_is_object(column))
    return rows.select(F.from_json(c, schema).alias("o"), (F.col("row_index") + 1).alias("_source_row_id")).select("o.*", "_source_row_id", F.lit(table).alias("_source_table"), F.lit(column).alias("_source_column"))


def json_child_tables(df: DataFrame, table: str, order_by: list[str]) -> dict[str, DataFrame]:
    """A table for each text column of JSON objects; the columns are tried together, in one look at the first rows."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in order_by]
    return {f"{table}_{c}_json": _child(df, table, c, order_by) for c in columns_of_objects(df, texts, order_by)}


def table_from_objects(spark: SparkSession, objects: list[dict]) -> DataFrame:
    """Python objects as a table: a key with any text is text, else double, integer or boolean."""
    keys = list(dict.fromkeys(k for o in objects for k in o))

    def kind(k: str) -> str:
        kinds = {type(o[k]) for o in objects if o.get(k) is not None}
        return "string" if not kinds or kinds - {int, float, bool} else "double" if float in kinds else "bigint" if int in kinds else "boolean"

    kinds = {k: kind(k) for k in keys}
    cast = {"string": str, "double": float, "bigint": int, "boolean": bool}
    rows = [tuple(None if o.get(k) is None else cast[kinds[k]](o[k]) for k in keys) for o in objects]
    return spark.createDataFrame(rows, ", ".join(f"`{clean_column(k, i)}` {kinds[k]}" for i, k in enumerate(keys)))
