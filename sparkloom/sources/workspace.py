"""A workspace: named tables over a Spark session, with loading, writing and raw SQL."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.filters import Filter, apply_filters
from . import databases, files
from .scratch import scratch_path
from .store import StoredTable, delete, read_text, write_text

#: The file of a workspace's folder that says what it holds.
MANIFEST = "workspace.json"


def session(app: str = "sparkloom", **conf: str) -> SparkSession:
    """The running session, or a new one with adaptive execution, UTC, and deep enough recursion for WITH RECURSIVE."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.cteRecursionLevelLimit", "100000")
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


class Workspace:
    """Named tables. Those that rows are put into are stored in ``folder`` (a scratch folder unless one is given), which ``reopen`` reads again."""

    def __init__(self, spark: SparkSession | None = None, folder: str | None = None):
        self.spark = spark or session()
        self.folder = folder.rstrip("/") if folder else None
        self.meta: dict[tuple[str, str], dict] = {}
        self.stored: dict[str, StoredTable] = {}
        self.current: str | None = None

    def create(self, name: str, df: DataFrame, connection: str = "default") -> str:
        """Register a table, replacing one of that name."""
        name = files.clean_table(name)
        self.stored.pop(name, None)
        return self._register(name, df, connection)

    def _register(self, name: str, df: DataFrame, connection: str = "default") -> str:
        df.createOrReplaceTempView(f"`{name}`")
        self.meta[name, connection] = {"name": name, "connection": connection, "columns": df.columns, "loaded": True}
        self.current = name
        return name

    def store(self, name: str, df: DataFrame) -> str:
        """As ``create``, with the rows written to the workspace's folder."""
        name = files.clean_table(name)
        self.folder = self.folder or scratch_path(self.spark, "tables")
        table = StoredTable(self.spark, f"{self.folder}/{name}-{uuid.uuid4().hex}")
        table.append(df)
        old = self.stored.get(name)
        self.stored[name] = table
        self._register(name, table.frame())
        if old:
            delete(self.spark, old.path)
        return name

    def create_as(self, name: str, query: str, **args) -> str:
        """A stored table of what a query returns."""
        return self.store(name, self.sql(query, **args))

    def insert(self, name: str, rows: DataFrame | str, **args) -> None:
        """Append rows, or what a query returns; columns that they lack are null. The table must exist, and is stored from then on.

        Rows go to files of their own: the table's plan stays one scan.
        """
        name = files.clean_table(name)
        if name not in self.stored:
            self.store(name, self.table(name))
        self.stored[name].append(self.sql(rows, **args) if isinstance(rows, str) else rows)
        self._register(name, self.stored[name].frame())

    def compact(self, name: str, files: int = 1) -> None:
        """A stored table in fewer files."""
        self.stored[name].compact(files)
        self._register(name, self.stored[name].frame())

    def drop(self, name: str, connection: str = "default") -> None:
        self.spark.catalog.dropTempView(name)
        self.meta.pop((name, connection), None)
        if name in self.stored:
            delete(self.spark, self.stored.pop(name).path)
        self.current = None if self.current == name else self.current

    def tables(self) -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables() if t.isTemporary)

    def table(self, name: str) -> DataFrame:
        return self.spark.table(f"`{name}`")

    def describe(self, name: str, order_by: Sequence[str] = ()) -> DataFrame:
        from ..operators.profile import describe_table

        return describe_table(self.table(name), order_by)

    def count(self, name: str, filters: Sequence[Filter] = ()) -> int:
        return apply_filters(self.table(name), filters).count()

    def page(self, name: str, order_by: Sequence[str], limit: int = 100, offset: int = 0) -> DataFrame:
        return self.table(name).orderBy(*order_by).offset(offset).limit(limit)

    def sql(self, query: str, **args) -> DataFrame:
        """Any Spark SQL; ``:name`` stands for an argument."""
        return self.spark.sql(query, args=args or None)

    def load(self, path: str, name: str | None = None, children: bool = True, **options) -> list[str]:
        """Load a file of any accepted kind. Text columns of JSON objects also become tables of their own."""
        kind, name = files.extension(path), name or files.base_name(path)
        if kind not in files.EXTENSIONS:
            raise ValueError(f"files of kind {kind!r} are not accepted")
        if kind in ("sqlite", "sqlite3", "db", "duckdb"):
            engine = files.database_kind(files.head(self.spark, path, 100))
            if engine == "unknown":
                raise ValueError(f"{path} is neither a SQLite nor a DuckDB file")
            return [self.create(t, df) for t, df in databases.read_database(self.spark, path, engine).items()]
        if kind == "txt":
            first = files.head(self.spark, path).split(b"\n", 1)[0]
            options.setdefault("sep", "\t" if first.count(b"\t") > first.count(b",") else ",")
        read = {"csv": files.read_csv, "txt": files.read_csv, "tsv": files.read_tsv, "json": files.read_json, "parquet": files.read_parquet}[kind]
        if kind == "json":
            placed = read(self.spark, path, at="__at", **options)
            df = placed.drop("__at")
        else:
            df = read(self.spark, path, **options)
            placed = df.withColumn("__at", F.monotonically_increasing_id())  # rows of a file are read in its order
        names = [self.create(name, df)]
        if children and kind != "parquet":
            found = files.json_child_tables(placed, names[0], ["__at"])
            names += [self.create(n, child) for n, child in found.items()]
        return names

    def load_all(self, paths: Sequence[str]) -> dict[str, list[str] | Exception]:
        """Load files one after the other; one that fails doesn't keep the others from loading."""
        out: dict[str, list[str] | Exception] = {}
        for p in paths:
            try:
                out[p] = self.load(p)
            except Exception as why:
                out[p] = why
        return out

    def union_counts(self, names: Sequence[str]) -> DataFrame:
        """(table_name, rows) of several tables."""
        return reduce(DataFrame.unionAll, (self.table(n).agg(F.lit(n).alias("table_name"), F.count("*").alias("rows")) for n in names))

    def union_tagged(self, names: Sequence[str]) -> DataFrame:
        """The rows of several tables with their table's name in ``source``; columns that a table lacks are null."""
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (self.table(n).withColumn("source", F.lit(n)) for n in names))

    def save_manifest(self, path: str | None = None) -> None:
        """What the workspace holds, as a file in its folder or elsewhere: tables, their columns, and where stored ones are."""
        if path is None:
            self.folder = self.folder or scratch_path(self.spark, "tables")
        tables = [m | ({"path": t.path, "schema": t.schema.jsonValue()} if (t := self.stored.get(m["name"])) else {}) for m in self.meta.values()]
        write_text(self.spark, path or f"{self.folder}/{MANIFEST}", json.dumps({"folder": self.folder, "current": self.current, "tables": tables}))

    @classmethod
    def reopen(cls, folder: str, spark: SparkSession | None = None, path: str | None = None) -> Workspace:
        """A workspace as its manifest tells: stored tables are there again; the others are known, but not loaded."""
        out = cls(spark, folder)
        text = read_text(out.spark, path or f"{out.folder}/{MANIFEST}")
        if text is None:
            raise FileNotFoundError(f"{folder} holds no workspace")
        told = json.loads(text)
        for m in told["tables"]:
            if "path" in m:
                out.stored[m["name"]] = StoredTable(out.spark, m["path"], T.StructType.fromJson(m["schema"]))
                out._register(m["name"], out.stored[m["name"]].frame(), m["connection"])
            else:
                out.meta[m["name"], m["connection"]] = m | {"loaded": False}
        out.current = told["current"]
        return out


def write(df: DataFrame, path: str, kind: str = "csv", single: bool = False, mode: str = "overwrite") -> None:
    """Write as csv (quoted, with a header), json, parquet or sqlite; ``single`` makes one file."""
    if kind == "sqlite":
        write_sqlite(df, path)
        return
    out = (df.coalesce(1) if single else df).write.mode(mode)
    {"csv": lambda: out.option("header", True).option("escape", '"').csv(path), "json": lambda: out.json(path), "parquet": lambda: out.parquet(path)}[kind]()


def write_sqlite(df: DataFrame, path: str, table: str = "data") -> None:
    """One table of a SQLite file: an export for small results, written by the driver, batch by batch, as the file has one writer."""
    import sqlite3

    kinds = {"bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "boolean": "BOOLEAN"}
    con = sqlite3.connect(path)
    con.execute(f'DROP TABLE IF EXISTS "{table}"')
    con.execute(f'CREATE TABLE "{table}" ({", ".join(f'"{n}" {kinds.get(k, "TEXT")}' for n, k in df.dtypes)})')
    plain = df.select(*(c if k in kinds else F.col(f"`{c}`").cast("string").alias(c) for c, k in df.dtypes))
    con.executemany(f'INSERT INTO "{table}" VALUES ({", ".join("?" * len(df.columns))})', (tuple(r) for r in plain.toLocalIterator()))
    con.commit()
    con.close()
