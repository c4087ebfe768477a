"""Tables in SQLite and DuckDB files, as a Spark data source."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import closing

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def affinity(declared: str) -> str:
    """A Spark type for a declared column type, by the rules for type names."""
    d = (declared or "").upper()
    if "BOOL" in d:
        return "boolean"
    if "INT" in d:
        return "bigint"
    if any(x in d for x in ("REAL", "FLOA", "DOUB", "NUM", "DEC")):
        return "double"
    return "binary" if "BLOB" in d else "string"


def _connect(path: str, engine: str):
    path = path.removeprefix("file://").removeprefix("file:")
    if engine == "duckdb":
        import duckdb  # only where it is installed

        return duckdb.connect(path, read_only=True)
    import sqlite3

    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def list_tables(path: str, engine: str = "sqlite") -> list[str]:
    """User tables of a database file."""
    con = _connect(path, engine)
    try:
        q = "SELECT table_name FROM information_schema.tables WHERE table_schema = 'main' ORDER BY 1" if engine == "duckdb" else "SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite\\_%' ESCAPE '\\' ORDER BY 1"
        return [r[0] for r in con.execute(q).fetchall()]
    finally:
        con.close()


class Rows(InputPartition):
    """Rows by rowid from low up to high; all of a table or view that has no rowid."""

    def __init__(self, low: int | None, high: int | None):
        self.low, self.high = low, high


class DatabaseReader(DataSourceReader):
    def __init__(self, options: dict, kinds: list[str]):
        self.path, self.table, self.engine = options["path"], options["dbtable"], options.get("engine", "sqlite")
        self.parts, self.kinds = int(options.get("numpartitions", 4)), kinds

    def partitions(self) -> list[Rows]:
        with closing(_connect(self.path, self.engine)) as con:
            try:
                low, high, rows = con.execute(f"SELECT min(rowid), max(rowid), count(*) FROM {_quoted(self.table)}").fetchone()
            except Exception as why:
                if "rowid" not in str(why):
                    raise
                return [Rows(None, None)]
            if not isinstance(low, int):  # no rows, or a view
                return [Rows(None, None)]
            if high - low + 1 <= 2 * rows:
                step = max(1, -(-(high - low + 1) // self.parts))
                starts = list(range(low, high + 1, step))
            else:  # ids with wide gaps: as many rows in each range
                step = max(1, -(-rows // self.parts))
                starts = [con.execute(f"SELECT rowid FROM {_quoted(self.table)} ORDER BY rowid LIMIT 1 OFFSET {i}").fetchone()[0] for i in range(0, rows, step)]
        return [Rows(a, b) for a, b in zip(starts, [*starts[1:], high + 1], strict=True)]

    def read(self, partition: Rows) -> Iterator[tuple]:
        text = lambda v: v if isinstance(v, str) else v.decode("utf-8", "replace") if isinstance(v, bytes) else str(v)
        cast = {"string": text, "bigint": int, "double": float, "boolean": bool, "binary": bytes}
        which = "" if partition.low is None else f" WHERE rowid >= {partition.low} AND rowid < {partition.high}"
        with closing(_connect(self.path, self.engine)) as con:
            cur = con.execute(f"SELECT * FROM {_quoted(self.table)}{which}")
            while rows := cur.fetchmany(10_000):
                for r in rows:
                    yield tuple(None if v is None else cast[k](v) for v, k in zip(r, self.kinds, strict=True))


class DatabaseSource(DataSource):
    """``spark.read.format("database_file")`` with options path, dbtable, engine (sqlite or duckdb) and numPartitions."""

    @classmethod
    def name(cls) -> str:
        return "database_file"

    def _columns(self) -> list[tuple[str, str]]:
        con = _connect(self.options["path"], self.options.get("engine", "sqlite"))
        try:
            table, engine = _quoted(self.options["dbtable"]), self.options.get("engine", "sqlite")
            found = [(r[1], affinity(r[2])) for r in con.execute(f"PRAGMA table_info({table})").fetchall()]
            fits = {"bigint": "'integer'", "double": "'integer', 'real'", "boolean": "'integer'", "binary": "'blob'"}
            typed = [n for n, k in found if k in fits] if engine == "sqlite" else []
            if typed:  # a column of this engine may hold values of any type: it is text if one isn't of the declared type
                tests = ", ".join(f"max(typeof({_quoted(n)}) NOT IN ('null', {fits[k]}))" for n, k in found if n in typed)
                odd = {n for n, x in zip(typed, con.execute(f"SELECT {tests} FROM {table}").fetchone(), strict=True) if x}
                found = [(n, "string" if n in odd else k) for n, k in found]
            return found
        finally:
            con.close()

    def schema(self) -> str:
        columns = self._columns()
        if not columns:
            raise ValueError(f"no table {self.options['dbtable']}")
        return ", ".join(f"`{n}` {k}" for n, k in columns)

    def reader(self, schema) -> DatabaseReader:
        return DatabaseReader(self.options, [k for _, k in self._columns()])


def read_table(spark: SparkSession, path: str, table: str, engine: str = "sqlite", parts: int = 4) -> DataFrame:
    spark.dataSource.register(DatabaseSource)
    return spark.read.format("database_file").options(path=path, dbtable=table, engine=engine, numPartitions=parts).load()


def read_database(spark: SparkSession, path: str, engine: str = "sqlite") -> dict[str, DataFrame]:
    return {t: read_table(spark, path, t, engine) for t in list_tables(path, engine)}
