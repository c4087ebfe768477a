"""Watching tables for changes, and tables that change: Structured Streaming."""

from __future__ import annotations

import contextlib
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import exists

KEPT = 50
_ROW = "id long, table_name string, change_type string, count long, at timestamp, acknowledged boolean"


@dataclass(frozen=True)
class Notification:
    id: int
    table_name: str
    change_type: str
    count: int
    at: datetime
    acknowledged: bool = False


def classify(before: int, now: int) -> tuple[str, int] | None:
    """More rows were inserted, fewer deleted; the same number is no change."""
    return None if now == before else ("inserted" if now > before else "deleted", abs(now - before))


@dataclass
class Notifications:
    """The latest notifications, newest first."""

    rows: list[Notification] = field(default_factory=list)
    listeners: list[Callable[[Notification], None]] = field(default_factory=list)
    made: int = 0

    def add(self, table: str, change: str, count: int) -> Notification:
        self.made += 1
        new = Notification(self.made, table, change, count, datetime.now(timezone.utc))
        self.rows = [new, *self.rows][:KEPT]
        for f in list(self.listeners):
            with contextlib.suppress(Exception):  # one listener's failure is not the others'
                f(new)
        return new

    def acknowledge(self, number: int) -> None:
        self.rows = [replace(n, acknowledged=True) if n.id == number else n for n in self.rows]

    def unacknowledged(self) -> int:
        return sum(not n.acknowledged for n in self.rows)

    def clear(self) -> None:
        self.rows = []

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(n.id, n.table_name, n.change_type, n.count, n.at, n.acknowledged) for n in self.rows], _ROW)


@dataclass
class Subscription:
    table_name: str
    count: Callable[[], int]
    rows: int = 0
    active: bool = True
    checked: datetime | None = None
    error: str | None = None


class Monitor:
    """Counts subscribed tables at every tick, tells of changes, and runs registered analyses again."""

    def __init__(self, spark: SparkSession, seconds: int = 30):
        self.spark, self.seconds, self.enabled = spark, max(5, min(3600, seconds)), True
        self.subscriptions: dict[str, Subscription] = {}
        self.notifications = Notifications()
        self.analyses: dict[str, list[Callable[[str], object]]] = {}
        self.query: StreamingQuery | None = None

    def subscribe(self, table: str, count: Callable[[], int] | None = None) -> None:
        count = count or (lambda: self.spark.table(table).count())
        self.subscriptions[table] = Subscription(table, count, count())

    def unsubscribe(self, table: str) -> None:
        self.subscriptions.pop(table, None)

    def toggle(self, table: str) -> None:
        self.subscriptions[table].active = not self.subscriptions[table].active

    def on_change(self, table: str, analysis: Callable[[str], object]) -> None:
        self.analyses.setdefault(table, []).append(analysis)

    def check(self) -> list[Notification]:
        """One tick: every active table. One that can't be counted, or whose analysis fails, doesn't stop the others; its ``error`` says why."""
        out = []
        for s in list(self.subscriptions.values()):
            if not s.active:
                continue
            s.error = None
            try:
                now = s.count()
            except Exception as why:
                s.error = f"count: {why}"
                continue
            change = classify(s.rows, now)
            s.rows, s.checked = now, datetime.now(timezone.utc)
            if change:
                out.append(self.notifications.add(s.table_name, *change))
                for run in self.analyses.get(s.table_name, []):
                    try:
                        run(s.table_name)
                    except Exception as why:
                        s.error = f"analysis: {why}"
        return out

    def start(self) -> StreamingQuery | None:
        """Tick as a streaming query, if enabled and anything is subscribed."""
        if not self.enabled or not self.subscriptions or self.query is not None:
            return self.query
        ticks = self.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        self.query = ticks.writeStream.trigger(processingTime=f"{self.seconds} seconds").foreachBatch(lambda _df, _n: self.check() and None).start()
        return self.query

    def stop(self) -> None:
        if self.query is not None:
            self.query.stop()
            self.query = None

    def configure(self, enabled: bool | None = None, seconds: int | None = None) -> None:
        self.stop()
        self.enabled = self.enabled if enabled is None else enabled
        self.seconds = self.seconds if seconds is None else max(5, min(3600, seconds))
        self.start()


class DurableMonitor:
    """Tells of rows that arrive in folders of files, through restarts: a streaming query with its checkpoint in ``folder``.

    Each batch writes its counts under its number, so a batch that is run again after a failure replaces what it wrote:
    no row is missed or told twice. Notifications and acknowledgements are tables in ``folder``; whoever opens it next
    has them all.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.query: StreamingQuery | None = None

    def start(self, tables: dict[str, tuple[str, T.StructType]], seconds: int | None = None) -> StreamingQuery:
        """Watch name -> (folder of Parquet files, schema): every ``seconds``, or, without, until all that is there has been told."""
        streams = [self.spark.readStream.schema(schema).parquet(path).select(F.lit(name).alias("table_name")) for name, (path, schema) in sorted(tables.items())]
        counted = reduce(DataFrame.unionAll, streams)
        out = f"{self.folder}/notifications"

        def tell(batch: DataFrame, number: int) -> None:
            rows = batch.groupBy("table_name").agg(F.count("*").alias("count")).select("table_name", F.lit("inserted").alias("change_type"), "count", F.current_timestamp().alias("at"))
            rows.coalesce(1).write.mode("overwrite").parquet(f"{out}/batch={number}")

        trigger = {"processingTime": f"{seconds} seconds"} if seconds else {"availableNow": True}
        self.query = counted.writeStream.option("checkpointLocation", f"{self.folder}/checkpoint").trigger(**trigger).foreachBatch(tell).start()
        return self.query

    def catch_up(self, tables: dict[str, tuple[str, T.StructType]]) -> None:
        """Tell of all that has arrived so far."""
        self.start(tables).awaitTermination()

    def stop(self) -> None:
        if self.query is not None:
            self.query.stop()
            self.query = None

    def notifications(self, latest: int | None = None) -> DataFrame:
        """(batch, table_name, change_type, count, total, at, acknowledged), all or the ``latest`` of them; total: rows of the table so far."""
        kind = "table_name string, change_type string, count long, at timestamp, batch long"
        there = exists(self.spark, f"{self.folder}/notifications")
        told = self.spark.read.schema(kind).parquet(f"{self.folder}/notifications") if there else self.spark.createDataFrame([], kind)
        seen = self.spark.read.schema("batch long, table_name string").parquet(f"{self.folder}/seen").distinct() if exists(self.spark, f"{self.folder}/seen") else self.spark.createDataFrame([], "batch long, table_name string")
        total = F.sum("count").over(Window.partitionBy("table_name").orderBy("batch"))  # a row for each batch
        rows = told.withColumn("total", total).join(seen.withColumn("acknowledged", F.lit(True)), ["batch", "table_name"], "left")
        rows = rows.select("batch", "table_name", "change_type", "count", "total", "at", F.coalesce("acknowledged", F.lit(False)).alias("acknowledged"))
        return rows if latest is None else rows.orderBy(F.desc("batch"), "table_name").limit(latest)

    def acknowledge(self, batch: int, table: str) -> None:
        self.spark.createDataFrame([(batch, table)], "batch long, table_name string").coalesce(1).write.mode("append").parquet(f"{self.folder}/seen")


def window_counts(stream: DataFrame, time: str, value: str, width: str = "1 hour", late: str = "1 hour", by: tuple[str, ...] = ()) -> DataFrame:
    """Mean and count in tumbling windows, with a watermark; works on streams and on tables."""
    rows = stream.withColumn(time, F.col(time).cast("timestamp"))
    rows = rows.withWatermark(time, late) if stream.isStreaming else rows
    out = rows.groupBy(F.window(time, width), *by).agg(F.avg(value).alias("value"), F.count("*").alias("count"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("period"), *by, "value", "count")


def run_to_end(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Everything a stream has now, as a table in memory."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
