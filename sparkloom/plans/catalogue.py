"""The library's queries over the synthetic tables, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import display
from ..functions.coerce import epoch_ms, equal_width_bin, is_date, num, safe_percent, size_band, steady
from ..operators import analysis, information, mining, missing, multivariate, preview, profile, sampling, series, stats, text
from ..operators.filters import Filter, apply_filters
from ..operators.ordering import with_row_index
from ..sources import databases, workspace
from ..sources.scratch import scratch_path
from ..streaming import monitor, simulator

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return add


def even(df: DataFrame, *columns: str) -> DataFrame:
    """The named doubles without noise in the last digits."""
    return df.withColumns({c: steady(F.col(c)) for c in columns})


def st(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.37) / 1e6"


# Filters: one query for each operator.
_FILTERS: dict[str, tuple[str, list[Filter], str]] = {
    "filter_equals": ("lineitem", [Filter("l_returnflag", "equals", "A")], "l_returnflag = 'A'"),
    "filter_not_equals": ("lineitem", [Filter("l_linestatus", "not_equals", "O")], "l_linestatus <> 'O'"),
    "filter_greater_than": ("lineitem", [Filter("l_quantity", "greater_than", 45)], "l_quantity > 45"),
    "filter_less_than": ("lineitem", [Filter("l_discount", "less_than", 0.02)], "l_discount < 0.02"),
    "filter_greater_equal": ("orders", [Filter("o_totalprice", "greater_equal", 300000)], "o_totalprice >= 300000"),
    "filter_less_equal": ("part", [Filter("p_size", "less_equal", 5)], "p_size <= 5"),
    "filter_contains": ("part", [Filter("p_type", "contains", "DIU")], "p_type LIKE '%DIU%'"),
    "filter_not_contains": ("part", [Filter("p_type", "not_contains", "DIU")], "p_type NOT LIKE '%DIU%'"),
    "filter_starts_with": ("part", [Filter("p_type", "starts_with", "PROMO")], "p_type LIKE 'PROMO%'"),
    "filter_ends_with": ("part", [Filter("p_type", "ends_with", "ARD")], "p_type LIKE '%ARD'"),
    "filter_is_not_null": ("customer", [Filter("c_mktsegment", "is_not_null")], "c_mktsegment IS NOT NULL"),
    "filter_in": ("orders", [Filter("o_orderpriority", "in", values=["1-URGENT", "2-HIGH"])], "o_orderpriority IN ('1-URGENT', '2-HIGH')"),
    "filter_not_in": ("orders", [Filter("o_orderpriority", "not_in", values=["1-URGENT", "2-HIGH"])], "o_orderpriority NOT IN ('1-URGENT', '2-HIGH')"),
    "filter_empty_in": ("orders", [Filter("o_orderpriority", "in")], "1 = 0"),
    "filter_empty_not_in": ("orders", [Filter("o_orderpriority", "not_in")], "1 = 1"),
    "filter_compound": ("lineitem", [Filter("l_returnflag", "equals", "R"), Filter("l_quantity", "greater_equal", 30), Filter("l_tax", "less_than", 0.05), Filter("l_linestatus", "equals", "X", active=False)], "l_returnflag = 'R' AND l_quantity >= 30 AND l_tax < 0.05"),
}
for _name, (_table, _filters, _where) in _FILTERS.items():
    query(f"SELECT * FROM {_table} WHERE {_where}", _name)(lambda s, d, t=_table, f=_filters: apply_filters(table(s, d, t), f))


def _with_nulls(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").withColumn("status", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderstatus")))


for _name, _filter in (("filter_equals_null", Filter("status", "equals", None)), ("filter_is_null", Filter("status", "is_null")), ("filter_null_in_compound", (Filter("status", "is_null"), Filter("o_orderpriority", "starts_with", "1")))):
    _where = "o_orderkey % 4 = 0" + (" AND o_orderpriority LIKE '1%'" if isinstance(_filter, tuple) else "")
    query(f"SELECT *, CAST(NULL AS VARCHAR) AS status FROM orders WHERE {_where}", _name)(lambda s, d, f=_filter: apply_filters(_with_nulls(s, d), list(f) if isinstance(f, tuple) else [f]))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 3 = 0 OR o_orderstatus <> 'F'")
def filter_keeping_nulls(s, d):
    rows = table(s, d, "orders").select("o_orderkey", "o_orderstatus").withColumn("v", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")))
    return apply_filters(rows, [Filter("v", "not_equals", "F")], null_mode="memory").drop("v")


@query("SELECT l_orderkey, l_extendedprice, l_discount FROM lineitem")
def scan_project(s, d):
    return table(s, d, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount")


@query("SELECT * FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC, c_custkey LIMIT 25 OFFSET 25")
def preview_page_sorted(s, d):
    return preview.preview(table(s, d, "customer"), [Filter("c_mktsegment", "equals", "BUILDING")], "c_acctbal", True, 2, 25, then=["c_custkey"])


@query("SELECT count(*) AS total, count(*) FILTER (WHERE c_acctbal > 5000) AS filtered FROM customer")
def preview_counts(s, d):
    return preview.counts(table(s, d, "customer"), [Filter("c_acctbal", "greater_than", 5000)])


@query("SELECT event_type AS value, count(*) AS count FROM events GROUP BY 1 ORDER BY 2 DESC, min(event_id) LIMIT 3")
def preview_top_values(s, d):
    return preview.top_values(table(s, d, "events"), "event_type", ["event_id"], 3)


@query("SELECT p_brand AS value FROM part GROUP BY 1 ORDER BY min(p_partkey) LIMIT 10")
def preview_first_values(s, d):
    return preview.first_values(table(s, d, "part"), "p_brand", ["p_partkey"])


_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_LONG = "WITH x AS (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, {c} AS x FROM lineitem WHERE l_returnflag = 'A'" for c in _NUMBERS) + ")"
_RETURNED = [Filter("l_returnflag", "equals", "A")]


@query(f"{_LONG} SELECT column_name, count(x) AS count, {st('avg(x)')} AS mean, {st('stddev_samp(x)')} AS std, min(x) AS min, max(x) AS max, {st('quantile_cont(x, 0.25)')} AS q1, {st('quantile_cont(x, 0.5)')} AS q2, {st('quantile_cont(x, 0.75)')} AS q3 FROM x GROUP BY 1")
def basic_stats_sql(s, d):
    return even(stats.basic_stats_sql(table(s, d, "lineitem"), _NUMBERS, _RETURNED), "mean", "std", "q1", "q2", "q3")


@query(f"{_LONG}, r AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY x) AS i, count(*) OVER (PARTITION BY column_name) AS n FROM x) SELECT column_name, count(x) AS count, {st('avg(x)')} AS mean, {st('stddev_pop(x)')} AS std, min(x) AS min, max(x) AS max, max(CASE WHEN i = floor(n * 0.25) + 1 THEN x END) AS q1, max(CASE WHEN i = floor(n * 0.5) + 1 THEN x END) AS q2, max(CASE WHEN i = floor(n * 0.75) + 1 THEN x END) AS q3 FROM r GROUP BY 1")
def basic_stats(s, d):
    return even(stats.basic_stats(table(s, d, "lineitem"), _NUMBERS, _RETURNED), "mean", "std")


_CORR = " UNION ALL ".join(f"SELECT '{a}' AS column1, '{b}' AS column2, corr({a}, {b}) AS r FROM lineitem" for i, a in enumerate(_NUMBERS) for b in _NUMBERS[i + 1 :])
_CORR_SQL = f"SELECT column1, column2, {st('r')} AS correlation, CASE WHEN abs(r) > 0.7 THEN 'strong' WHEN abs(r) > 0.3 THEN 'moderate' ELSE 'weak' END AS strength FROM ({_CORR})"


@query(_CORR_SQL)
def correlation_matrix(s, d):
    return even(stats.correlation_matrix(table(s, d, "lineitem"), _NUMBERS), "correlation")


@query(_CORR_SQL)
def correlation_matrix_sql(s, d):
    return even(stats.correlation_matrix_sql(table(s, d, "lineitem"), _NUMBERS), "correlation")


@query(f"""
WITH f AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(*) AS n FROM orders),
b AS (SELECT CAST(least(floor((o_totalprice - lo) / ((hi - lo) / 10)), 9) AS INTEGER) AS bin, count(*) AS c FROM orders, f GROUP BY 1)
SELECT CAST(i AS INTEGER) AS bin, {st('lo + i * ((hi - lo) / 10)')} AS low, {st('lo + (i + 1) * ((hi - lo) / 10)')} AS high, CAST(lo + i * ((hi - lo) / 10) AS DECIMAL(18, 1)) || '-' || CAST(lo + (i + 1) * ((hi - lo) / 10) AS DECIMAL(18, 1)) AS label, coalesce(c, 0) AS count, CAST(CAST(coalesce(c, 0) * 100.0 / n AS DECIMAL(9, 1)) AS VARCHAR) AS frequency
FROM range(10) r(i) CROSS JOIN f LEFT JOIN b ON b.bin = i""")
def histogram(s, d):
    return even(stats.histogram(table(s, d, "orders"), "o_totalprice", 10), "low", "high")


@query(f"""
WITH f AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(*) AS n FROM orders),
b AS (SELECT CAST(floor((o_totalprice - lo) / ((hi - lo) / 20)) AS INTEGER) AS bin, lo, hi, n, count(*) AS c FROM orders, f WHERE o_totalprice < hi GROUP BY ALL)
SELECT bin, {st('lo + bin * ((hi - lo) / 20)')} AS low, {st('lo + (bin + 1) * ((hi - lo) / 20)')} AS high, c AS count, {st('c * 100.0 / n')} AS frequency FROM b""")
def histogram_sql(s, d):
    return even(stats.histogram_sql(table(s, d, "orders"), "o_totalprice", 20), "low", "high", "frequency")


_FORMS = {"hour": "%Y-%m-%d %H:00:00", "day": "%Y-%m-%d", "week": "%G-W%V", "month": "%Y-%m"}
for _i, _form in _FORMS.items():
    query(f"SELECT strftime(ts, '{_form}') AS period, {st('avg(value)')} AS value, count(*) AS count FROM events GROUP BY 1", f"timeseries_{_i}_sql")(
        lambda s, d, i=_i: even(series.time_buckets_sql(table(s, d, "events"), "value", "ts", i), "value")
    )
query(f"SELECT strftime(o_orderdate, '%G-W%V') AS period, {st('avg(o_totalprice)')} AS value, count(*) AS count FROM orders GROUP BY 1", "timeseries_orders_week_sql")(
    lambda s, d: even(series.time_buckets_sql(table(s, d, "orders"), "o_totalprice", "o_orderdate", "week"), "value")
)

_UNIFORM = """WITH e AS (SELECT *, row_number() OVER (ORDER BY {k}) - 1 AS row_index, count(*) OVER () AS n FROM events),
u AS (SELECT DISTINCT CAST(CASE WHEN i = 0 THEN 0 WHEN i = {m} - 1 THEN n - 1 ELSE floor(i * (n / {m}) + 0.5) END AS BIGINT) AS pos FROM range({m}) r(i), (SELECT max(n) AS n FROM e)),
p AS (SELECT * FROM e WHERE n <= {m} OR row_index IN (SELECT pos FROM u))"""


@query(
    _UNIFORM.format(k="ts, event_id", m=1500)
    + f""", q AS (SELECT *, row_number() OVER (ORDER BY row_index) - 1 AS i, count(*) OVER () AS k FROM p),
w AS (SELECT a.i, a.value, (SELECT avg(b.value) FROM q b WHERE b.i <= a.i AND b.i > a.i - greatest(3, floor(a.k / 20))) AS m FROM q a),
l AS (SELECT regr_slope(value, i) AS a, regr_intercept(value, i) AS b FROM q)
SELECT i AS index, value, {st('m')} AS moving_average, {st('a * i + b')} AS trend, CASE WHEN a > 0 THEN 'increasing' WHEN a < 0 THEN 'decreasing' ELSE 'stable' END AS direction FROM w, l"""
)
def timeseries_trend(s, d):
    return even(series.time_series(table(s, d, "events"), "value", "ts", ["event_id"]), "moving_average", "trend").drop("x")


@query(f"""
WITH m AS (SELECT row_number() OVER (ORDER BY event_id) AS i, value, avg(value) OVER (ORDER BY event_id ROWS 9 PRECEDING) AS m10, avg(value) OVER (ORDER BY event_id ROWS 4 PRECEDING) AS m5 FROM events),
c AS (SELECT i, value, abs(m5 - m10) AS score FROM m WHERE i > 10), t AS (SELECT avg(score) + 2 * stddev_samp(score) AS th FROM c)
SELECT i AS index, value, {st('score')} AS score, {st('least(score / th, 1.0)')} AS confidence FROM c, t WHERE score > th""")
def changepoint_sql(s, d):
    return even(series.change_points_sql(table(s, d, "events"), "value", ["event_id"]), "score", "confidence")


_CP = _UNIFORM.format(k="event_id", m=2000) + ", x AS (SELECT row_number() OVER (ORDER BY row_index) - 1 AS i, CAST(row_index AS DOUBLE) AS x, value AS v, count(*) OVER () AS n, avg(value) OVER () AS mu, stddev_pop(value) OVER () AS sd FROM p)"
#: Events whose value stands on six steps of three heights.
_STEPS = _CP.replace("WITH e AS (SELECT *,", "WITH events AS (SELECT event_id, value / 20 + 400 * (event_id * 6 // (SELECT count(*) FROM main.events) % 3) AS value FROM main.events), e AS (SELECT *,")
_LEVEL = "CASE WHEN confidence >= 0.8 THEN 'very high' WHEN confidence >= 0.6 THEN 'high' WHEN confidence >= 0.4 THEN 'medium' ELSE 'low' END AS level"


def _stepped(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    step = F.floor(F.col("event_id") * 6 / F.lit(e.count())) % 3
    return e.select("event_id", (F.col("value") / 20 + 400 * step).alias("value"))


@query(_STEPS + f""", w AS (SELECT *, avg(v) OVER (ORDER BY i ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS a, avg(v) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS b FROM x),
r AS (SELECT i AS index, x, v AS value, least(abs(b - a) / (2 * sd), 3) / 3 AS confidence FROM w WHERE i >= 10 AND i < n - 10 AND abs(b - a) > 2 * sd)
SELECT index, x, {st('value')} AS value, {st('confidence')} AS confidence, {_LEVEL} FROM r""")
def changepoint_moving_average(s, d):
    return even(series.change_points(_stepped(s, d), "value", order_by=["event_id"]), "value", "confidence")


@query()
def changepoint_moving_average_reference(s, d):
    return series.change_points(_stepped(s, d), "value", order_by=["event_id"], exact_reference=True)


@query("WITH RECURSIVE " + _CP.removeprefix("WITH ") + f""", c(i, v, up, down, hit, u, dn) AS (
 SELECT CAST(-1 AS BIGINT), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), false, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE)
 UNION ALL
 SELECT i, v, CASE WHEN h THEN 0 ELSE a END, CASE WHEN h THEN 0 ELSE b END, h, a, b FROM (
  SELECT x.i, x.v, greatest(0, c.up + x.v - mu - 20) AS a, least(0, c.down + x.v - mu + 20) AS b, (greatest(0, c.up + x.v - mu - 20) > 100 OR -least(0, c.down + x.v - mu + 20) > 100) AS h FROM c JOIN x ON x.i = c.i + 1))
SELECT i AS index, v AS value, {st('least(greatest(u, -dn) / 100, 3) / 3')} AS confidence FROM c WHERE hit""")
def changepoint_cusum(s, d):
    return even(series.change_points(table(s, d, "events"), "value", order_by=["event_id"], algorithm="cusum", drift=20.0, threshold=100.0), "confidence").drop("x", "level")


@query("WITH RECURSIVE " + _CP.removeprefix("WITH ") + f""", c(i, v, e, sd) AS (
 SELECT CAST(-1 AS BIGINT), CAST(0 AS DOUBLE), max(mu), max(sd) FROM x
 UNION ALL SELECT x.i, x.v, 0.1 * x.v + 0.9 * c.e, c.sd FROM c JOIN x ON x.i = c.i + 1)
SELECT i AS index, v AS value, {st('least(abs(v - e) / sd / 3, 3) / 3')} AS confidence FROM c WHERE i >= 0 AND abs(v - e) / sd > 3""")
def changepoint_ewma(s, d):
    return even(series.change_points(table(s, d, "events"), "value", order_by=["event_id"], algorithm="ewma"), "confidence").drop("x", "level")


@query()
def changepoint_binary_segmentation(s, d):
    return series.change_points(_stepped(s, d), "value", order_by=["event_id"], algorithm="binary_segmentation")


_PROFILED = ["o_orderstatus", "o_orderpriority", "o_totalprice", "o_custkey"]
_PROFILE_LONG = " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS v, {f'CAST({c} AS DOUBLE)' if c in ('o_totalprice', 'o_custkey') else 'CAST(NULL AS DOUBLE)'} AS x FROM orders" for c in _PROFILED)


@query(f"""
WITH l AS ({_PROFILE_LONG}), r AS (SELECT column_name, x, row_number() OVER (PARTITION BY column_name ORDER BY x) AS i, count(*) OVER (PARTITION BY column_name) AS n FROM l WHERE x IS NOT NULL),
m AS (SELECT column_name, max(CASE WHEN i = floor(n / 2) + 1 THEN x END) AS median FROM r GROUP BY 1)
SELECT column_name, count(*) AS total, count(*) - count(v) AS nulls, count(DISTINCT v) AS "distinct", {st('avg(x)')} AS mean, {st('stddev_pop(x)')} AS std, min(x) AS min, max(x) AS max, max(median) AS median FROM l LEFT JOIN m USING (column_name) GROUP BY 1""")
def column_profile(s, d):
    p = profile.column_profile(table(s, d, "orders"), _PROFILED, order_by=["o_orderkey"])
    return even(p.select("column_name", "total", "nulls", "distinct", "mean", "std", "min", "max", "median"), "mean", "std")


@query(f"""
WITH l AS (SELECT 'o_orderstatus' AS column_name, o_orderstatus AS value, o_orderkey AS k FROM orders UNION ALL SELECT 'o_orderpriority', o_orderpriority, o_orderkey FROM orders),
c AS (SELECT column_name, value, count(*) AS c, min(k) AS k FROM l GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY c DESC, k) AS i, sum(c) OVER (PARTITION BY column_name) AS n FROM c)
SELECT column_name, CAST(i AS INTEGER) AS rank, value, c AS count, {st('c * 100.0 / n')} AS pct FROM r WHERE i <= 10""")
def column_top_values(s, d):
    return even(profile.profile_top_values(table(s, d, "orders"), ["o_orderstatus", "o_orderpriority"], ["o_orderkey"]), "pct")


@query("""
WITH c AS (SELECT 'p_brand' AS column_name, p_brand AS value, min(p_partkey) AS k FROM part GROUP BY 2), r AS (SELECT *, row_number() OVER (ORDER BY k) AS i FROM c)
SELECT column_name, CAST(i AS INTEGER) AS rank, value FROM r WHERE i <= 10""")
def column_samples(s, d):
    return profile.profile_samples(table(s, d, "part"), ["p_brand"], ["p_partkey"])


@query("SELECT unnest(['i', 'f', 'd', 'b', 't']) AS column_name, unnest(['INTEGER', 'FLOAT', 'DATE', 'BOOLEAN', 'TEXT']) AS inferred_type")
def infer_types(s, d):
    o = table(s, d, "orders")
    rows = o.select("o_orderkey", F.col("o_custkey").cast("string").alias("i"), F.format_string("%.2f", "o_totalprice").alias("f"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"), F.when(F.col("o_orderkey") % 2 == 0, "true").otherwise("false").alias("b"), F.col("o_orderpriority").alias("t"))
    return profile.infer_types(rows, ["i", "f", "d", "b", "t"], ["o_orderkey"])


@query("SELECT column_name, column_type FROM (SELECT unnest(['o_orderkey', 'o_orderstatus', 'o_orderdate']) AS column_name, unnest(['BIGINT', 'TEXT', 'TIMESTAMP_NTZ']) AS column_type)")
def describe_table(s, d):
    return profile.describe_table(table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate"), ["o_orderkey"]).select("column_name", "column_type")


def _gappy(s, d) -> DataFrame:
    k = F.col("event_id")
    v = F.when(k % 7 < 2, None).when(k % 11 == 0, "").when(k % 13 == 0, "0").otherwise(F.col("event_type"))
    return table(s, d, "events").select("event_id", v.alias("a"), F.when(k % 5 != 3, F.col("event_type")).alias("b"))


_GAPS = """
WITH e AS (SELECT event_id, CASE WHEN event_id % 7 < 2 THEN NULL WHEN event_id % 11 = 0 THEN '' WHEN event_id % 13 = 0 THEN '0' ELSE event_type END AS a, CASE WHEN event_id % 5 <> 3 THEN event_type END AS b FROM events),
l AS (SELECT 'a' AS column_name, row_number() OVER (ORDER BY event_id) - 1 AS i, a AS v FROM e UNION ALL SELECT 'b', row_number() OVER (ORDER BY event_id) - 1, b FROM e),
m AS (SELECT *, v IS NULL OR trim(v) = '' OR v = '0' AS miss FROM l),
p AS (SELECT *, coalesce(max(CASE WHEN NOT miss THEN i END) OVER (PARTITION BY column_name ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS valid, last_value(CASE WHEN NOT miss THEN v END IGNORE NULLS) OVER (PARTITION BY column_name ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM m),
q AS (SELECT *, i - valid - 1 AS since FROM p)"""


@query(_GAPS + " SELECT column_name, i AS row_index, CASE WHEN miss THEN 'missing_start' ELSE 'missing_end' END AS event, v AS value, CASE WHEN miss THEN prev END AS previous_value, CASE WHEN NOT miss THEN since END AS length FROM q WHERE (miss AND since = 0) OR (NOT miss AND since > 0)")
def missing_events(s, d):
    return missing.missing_events(missing.missing_flags(_gappy(s, d), ["a", "b"], ["event_id"]))


@query(_GAPS + f" SELECT column_name, count(*) AS total, count(*) FILTER (WHERE miss) AS missing, count(*) FILTER (WHERE miss AND since = 0) AS runs, {st('count(*) FILTER (WHERE miss) / count(*) FILTER (WHERE miss AND since = 0)')} AS avg_length, coalesce(max(CASE WHEN miss THEN since + 1 END), 0) AS max_length, {st('count(*) FILTER (WHERE miss) * 100.0 / count(*)')} AS missing_pct FROM q GROUP BY 1")
def missing_stats(s, d):
    return even(missing.missing_stats(missing.missing_flags(_gappy(s, d), ["a", "b"], ["event_id"])), "avg_length", "missing_pct")


@query(_GAPS + f", s AS (SELECT column_name, count(*) AS t, count(*) FILTER (WHERE miss) AS m, count(*) FILTER (WHERE miss AND since = 0) AS r FROM q GROUP BY 1) SELECT count(*) AS columns, max(t) AS rows, CAST(sum(m) AS BIGINT) AS missing, count(*) FILTER (WHERE m > 0) AS affected_columns, CAST(sum(r) AS BIGINT) AS runs, {st('sum(m) * 100.0 / sum(t)')} AS missing_pct FROM s")
def missing_summary(s, d):
    return even(missing.missing_summary(missing.missing_flags(_gappy(s, d), ["a", "b"], ["event_id"])), "missing_pct")


@query(_UNIFORM.format(k="event_id", m=1000) + " SELECT event_id, row_index FROM p")
def sample_uniform(s, d):
    return sampling.sample_rows(table(s, d, "events").select("event_id"), ["event_id"], 1000)


@query("WITH e AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS row_index, count(*) OVER () AS n FROM events) SELECT event_id, row_index FROM e WHERE row_index % (n // 1000) = 0 AND row_index < (n // 1000) * 1000")
def sample_systematic(s, d):
    return sampling.sample_rows(table(s, d, "events").select("event_id"), ["event_id"], 1000, "systematic")


@query("""
WITH e AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS row_index, count(*) OVER () AS n FROM events),
k AS (SELECT CAST(floor((floor(i * (n / 300)) + least(floor((i + 1) * (n / 300)), n) - 1) / 2) AS BIGINT) AS pos FROM range(300) r(i), (SELECT max(n) AS n FROM e))
SELECT event_id, row_index FROM e WHERE row_index IN (SELECT pos FROM k)""")
def sample_stratified(s, d):
    return sampling.sample_rows(table(s, d, "events").select("event_id"), ["event_id"], 300, "stratified")


@query("""
WITH e AS (SELECT event_id, value, row_number() OVER (ORDER BY event_id) - 1 AS i, count(*) OVER () AS n, lag(value) OVER (ORDER BY event_id) AS p, lead(value) OVER (ORDER BY event_id) AS q FROM events),
r AS (SELECT event_id, i, CASE WHEN i = 0 OR i = n - 1 THEN 0 WHEN (value > p AND value > q) OR (value < p AND value < q) THEN 1 WHEN i % (n // 500) = 0 THEN 2 END AS r FROM e)
SELECT event_id, i AS row_index FROM r WHERE r IS NOT NULL ORDER BY r, i LIMIT 500""")
def sample_peak(s, d):
    return sampling.sample_rows(table(s, d, "events").select("event_id", "value"), ["event_id"], 500, "peak", value="value").select("event_id", "row_index")


def _entropy(c: str) -> str:
    return f"(SELECT -sum(c / n * log2(c / n)) FROM (SELECT count(*) AS c, max(n) AS n FROM y GROUP BY {c}))"


@query(f"""
WITH f AS (SELECT min(value) AS lo, max(value) AS hi, count(*) AS n FROM events),
y AS (SELECT event_type AS u, least(floor((value - lo) / ((hi - lo) / 10)), 9) AS v, n FROM events, f),
h AS (SELECT {_entropy('u')} AS h1, {_entropy('v')} AS h2, {_entropy('u, v')} AS h12, max(n) AS n FROM y)
SELECT 'event_type' AS column1, 'value' AS column2, n, {st('h1')} AS h1, {st('h2')} AS h2, {st('h12')} AS h12, {st('h1 + h2 - h12')} AS mutual_information, {st('2 * (h1 + h2 - h12) / (h1 + h2)')} AS normalized FROM h""")
def mutual_information(s, d):
    m = information.mutual_information(table(s, d, "events"), ["event_type", "value"])
    return even(m.select("column1", "column2", "n", "h1", "h2", "h12", "mutual_information", "normalized"), "h1", "h2", "h12", "mutual_information", "normalized")


@query(f"""
WITH y AS (SELECT l_returnflag AS u, l_linestatus AS v, count(*) OVER () AS n FROM lineitem), h AS (SELECT {_entropy('u')} AS h1, {_entropy('v')} AS h2, {_entropy('u, v')} AS h12 FROM y LIMIT 1)
SELECT CAST(1 AS BIGINT) AS pairs, {st('h1 + h2 - h12')} AS mean, {st('h1 + h2 - h12')} AS max, {st('h1 + h2 - h12')} AS min, CAST(h1 + h2 - h12 > 0.1 AS BIGINT) AS strong FROM h""")
def mutual_information_summary(s, d):
    m = information.mutual_information(table(s, d, "lineitem"), ["l_returnflag", "l_linestatus"])
    return even(information.mutual_information_summary(m), "mean", "max", "min")


_ITEMS = ["o_orderstatus", "o_orderpriority", "o_totalprice"]
_BAND = "CASE WHEN o_totalprice < 0 THEN 'negative' WHEN o_totalprice = 0 THEN 'zero' WHEN o_totalprice <= 10 THEN 'low' WHEN o_totalprice <= 100 THEN 'medium' WHEN o_totalprice <= 1000 THEN 'high' ELSE 'very_high' END"
_SETS = f"""
WITH t AS (SELECT 'o_orderstatus=' || o_orderstatus AS a, 'o_orderpriority=' || o_orderpriority AS b, 'o_totalprice=' || {_BAND} AS c FROM orders),
k AS (SELECT unnest([[a], [b], [c], list_sort([a, b]), list_sort([a, c]), list_sort([b, c]), list_sort([a, b, c])]) AS s FROM t),
f AS (SELECT s, count(*) AS c, (SELECT count(*) FROM t) AS n FROM k GROUP BY 1 HAVING count(*) >= ceil(0.05 * (SELECT count(*) FROM t)))"""


@query(_SETS + f" SELECT array_to_string(s, '|') AS items, CAST(len(s) AS INTEGER) AS size, c AS count, {st('c / n')} AS support FROM f")
def association_itemsets(s, d):
    return even(mining.frequent_itemsets(table(s, d, "orders"), _ITEMS, min_support=0.05).withColumn("items", F.array_join("items", "|")), "support")


@query(_SETS + f""", r AS (SELECT x.s AS whole, a.s AS ante, b.s AS cons, x.c / x.n AS sup, a.c / a.n AS sa, b.c / b.n AS sc FROM f x JOIN f a ON len(a.s) < len(x.s) AND list_has_all(x.s, a.s) JOIN f b ON len(a.s) + len(b.s) = len(x.s) AND list_has_all(x.s, b.s) AND NOT list_has_any(a.s, b.s))
SELECT array_to_string(ante, '|') AS antecedent, array_to_string(cons, '|') AS consequent, {st('sup')} AS support, {st('sup / sa')} AS confidence, {st('sup / sa / sc')} AS lift FROM r WHERE sup / sa >= 0.3""")
def association_rules(s, d):
    rules = mining.association_rules(mining.frequent_itemsets(table(s, d, "orders"), _ITEMS, min_support=0.05), 0.3)
    out = rules.select(F.array_join("antecedent", "|").alias("antecedent"), F.array_join("consequent", "|").alias("consequent"), "support", "confidence", "lift")
    return even(out, "support", "confidence", "lift")


@query("WITH v AS (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, var_pop({c}) AS e FROM lineitem" for c in _NUMBERS) + f"), r AS (SELECT *, row_number() OVER (ORDER BY e DESC, column_name) AS i, e * 100 / sum(e) OVER () AS s FROM v), c AS (SELECT *, sum(s) OVER (ORDER BY i) AS t FROM r) SELECT CAST(i AS INTEGER) AS factor, column_name, {st('s')} AS share, {st('t')} AS cumulative FROM c WHERE i <= 2")
def pca_variance_sql(s, d):
    return even(multivariate.pca_variance_sql(table(s, d, "lineitem"), _NUMBERS), "share", "cumulative").drop("eigenvalue")


@query()
def pca(s, d):
    return multivariate.pca(table(s, d, "lineitem"), _NUMBERS)


@query(f"SELECT CAST(1 AS INTEGER) AS pair, {st('abs(corr(l_quantity, l_extendedprice))')} AS correlation, {st('1 - corr(l_quantity, l_extendedprice) ** 2')} AS wilks FROM lineitem")
def canonical_correlation_single(s, d):
    return even(multivariate.canonical_correlation(table(s, d, "lineitem"), ["l_quantity"], ["l_extendedprice"]).select("pair", "correlation", "wilks"), "correlation", "wilks")


@query(f"""
WITH r AS (SELECT corr(l_quantity, l_discount) AS a, corr(l_extendedprice, l_tax) AS b, corr(l_quantity, l_extendedprice) AS p, corr(l_quantity, l_tax) AS q, corr(l_discount, l_extendedprice) AS u, corr(l_discount, l_tax) AS v FROM lineitem),
m AS (SELECT (p - a * u) / (1 - a * a) AS m11, (q - a * v) / (1 - a * a) AS m12, (u - a * p) / (1 - a * a) AS m21, (v - a * q) / (1 - a * a) AS m22, (p - b * q) / (1 - b * b) AS n11, (u - b * v) / (1 - b * b) AS n12, (q - b * p) / (1 - b * b) AS n21, (v - b * u) / (1 - b * b) AS n22 FROM r),
k AS (SELECT m11 * n11 + m12 * n21 + m21 * n12 + m22 * n22 AS tr, (m11 * m22 - m12 * m21) * (n11 * n22 - n12 * n21) AS det FROM m),
e AS (SELECT (tr + sqrt(greatest(tr * tr - 4 * det, 0))) / 2 AS l1, (tr - sqrt(greatest(tr * tr - 4 * det, 0))) / 2 AS l2 FROM k)
SELECT CAST(1 AS INTEGER) AS pair, floor(sqrt(l1) * 1e5 + 0.37) / 1e5 AS correlation FROM e UNION ALL SELECT 2, floor(sqrt(greatest(l2, 0)) * 1e5 + 0.37) / 1e5 FROM e""")
def canonical_correlation(s, d):
    c = multivariate.canonical_correlation(table(s, d, "lineitem"), ["l_quantity", "l_discount"], ["l_extendedprice", "l_tax"])
    return c.select("pair", (F.floor(F.col("correlation") * 1e5 + 0.37) / 1e5).alias("correlation"))


_TOKENS = r"list_filter(regexp_split_to_array({t}, '[\s.,!?;:''\"()\[\]{{}}\-_/\\@#$%^&*+=<>|~`。、！？；：「」『』（）【】]+'), lambda x: x <> '')"
_SENTENCES = r"list_filter(list_transform(regexp_split_to_array(text, '[.!?。！？]+'), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> '')"


# Documents of which some are null, blank, numbers or in Japanese letters, by their id.
_LATIN, _KANA, _HIRAGANA, _KANJI = "abcdefghijklmnopqrstuvwxyz", "アイウエオカキクケコサシスセソタチツテトナニヌネノハ", "あいうえおかきくけこさしすせそたちつてとなにぬねのは", "日本語東京大学生時間人国会社今年新聞車駅前後食事水木"
_VARIED = f"""(SELECT CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN repeat(' ', CAST(doc_id % 5 AS INT)) || chr(10) WHEN doc_id % 13 = 0 THEN doc_id || ' ' || n_chars || '-007'
 WHEN doc_id % 17 = 0 THEN translate(lower(text), '{_LATIN}', '{_KANA}') WHEN doc_id % 19 = 0 THEN translate(lower(text), 'aeiou', 'あいうえお') ELSE text END AS text FROM documents)"""


def _varied(s: SparkSession, d: str) -> DataFrame:
    k, t = F.col("doc_id"), F.col("text")
    kinds = F.when(k % 7 == 0, F.lit(None)).when(k % 11 == 0, F.concat(F.repeat(F.lit(" "), (k % 5).cast("int")), F.lit("\n"))).when(k % 13 == 0, F.concat_ws("", k, F.lit(" "), "n_chars", F.lit("-007")))
    return table(s, d, "documents").select(kinds.when(k % 17 == 0, F.translate(F.lower(t), _LATIN, _KANA)).when(k % 19 == 0, F.translate(F.lower(t), "aeiou", "あいうえお")).otherwise(t).alias("text"))


_READABLE = "greatest(0, least(100, 100 - least({w} / {s} / 20, 1) * 40 - least(({c} / {w} - 3) / 5, 1) * 40))"
_MEASURED = rf"SELECT text, length(text) AS c, len({_TOKENS.format(t='text')}) AS w, len({_SENTENCES}) AS s, len(list_filter(regexp_split_to_array(text, '\n\s*\n|\r\n\s*\r\n'), lambda x: regexp_matches(x, '\S'))) AS p FROM {_VARIED} WHERE text IS NOT NULL"
_STATISTICS = {
    "records": "count(*)", "empty_records": r"count(*) FILTER (NOT regexp_matches(text, '\S'))", "unique_records": "count(DISTINCT text)",
    **{f"total_{k}": f"CAST(sum({v}) AS BIGINT)" for k, v in zip(text.MEASURES, "cwsp", strict=True)}, **{f"min_{k}": f"min({v})" for k, v in zip(text.MEASURES, "cws", strict=False)}, **{f"max_{k}": f"max({v})" for k, v in zip(text.MEASURES, "cws", strict=False)},
    **{f"median_{k}": f"max(CASE WHEN {v}i = floor(n / 2) + 1 THEN {v} END)" for k, v in zip(text.MEASURES, "cws", strict=False)},
}
_SHARES = {
    "empty_pct": r"count(*) FILTER (NOT regexp_matches(text, '\S')) * 100.0 / count(*)", "unique_pct": "count(DISTINCT text) * 100.0 / count(*)", **{f"mean_{k}": f"avg({v})" for k, v in zip(text.MEASURES, "cwsp", strict=True)},
    "words_per_sentence": "sum(w) / sum(s)", "readability": _READABLE.format(c="sum(c)", w="sum(w)", s="sum(s)"),
}


@query(f"""
WITH m AS ({_MEASURED}), q AS (SELECT *, row_number() OVER (ORDER BY c) AS ci, row_number() OVER (ORDER BY w) AS wi, row_number() OVER (ORDER BY s) AS si, count(*) OVER () AS n FROM m)
SELECT {', '.join(f'{v} AS {k}' for k, v in _STATISTICS.items())}, {', '.join(f'{st(v)} AS {k}' for k, v in _SHARES.items())} FROM q""")
def text_statistics(s, d):
    return even(text.text_statistics(_varied(s, d), "text"), *_SHARES)


@query(f"WITH w AS (SELECT unnest({_TOKENS.format(t='lower(text)')}) AS word FROM documents), c AS (SELECT word, count(*) AS c, sum(count(*)) OVER () AS n FROM w GROUP BY 1) SELECT word, c AS count, {st('c * 100.0 / n')} AS pct FROM c WHERE length(word) >= 2 ORDER BY c DESC, word LIMIT 20")
def word_frequency(s, d):
    return even(text.word_frequency(table(s, d, "documents"), "text"), "pct")


@query(f"WITH w AS (SELECT unnest(string_split(regexp_replace(text, '\\s', '', 'g'), '')) AS ch FROM documents), c AS (SELECT ch, count(*) AS c, sum(count(*)) OVER () AS n FROM w WHERE ch <> '' GROUP BY 1) SELECT ch AS char, c AS count, {st('c * 100.0 / n')} AS pct FROM c ORDER BY c DESC, ch LIMIT 20")
def char_frequency(s, d):
    return even(text.char_frequency(table(s, d, "documents"), "text"), "pct")


# Patterns over documents with some texts of other kinds among them: forms of numbers, addresses, Japanese, and such.
_ODD_TEXTS = ("well-known a/b\\c d_e", "日本語 テスト", "日本語とtext", "12345678901", "03-1234-5678", " 42 ", "007", "abc 123", "a@b.co", "x@y.Z|", "a+b@c-d.org.", "@no.mail", "http://x.y/z?q=1 z", "ひらがな", "カタカナ・漢字", "!?", "", " ", "tab\tand 'quote'", "(in) [all] {of} <them>", "1-2-3", "A1", "été naïve", "2024-01-02-0304")
_ODD = "SELECT unnest([" + ", ".join("'" + t.replace("'", "''") + "'" for t in _ODD_TEXTS) + "]) AS text"
_MIXED = f"(SELECT text FROM documents UNION ALL {_ODD} UNION ALL SELECT NULL)"


def _mixed(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("text").unionAll(s.createDataFrame([(t,) for t in (*_ODD_TEXTS, None)], "text string"))


_PATTERNS = {
    "email": r"regexp_matches(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b')",
    "url": r"regexp_matches(text, 'https?://[^\s]+')",
    "phone": r"regexp_matches(text, '(\d{2,4}-\d{2,4}-\d{4}|\d{10,11})')",
    "number_only": r"regexp_matches(trim(text), '^\d+$')",
    "japanese_only": r"regexp_matches(text, '^[\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{4E00}-\x{9FAF}\s]+$')",
    "alphanumeric_only": r"regexp_matches(text, '^[A-Za-z0-9\s]+$')",
}


@query(f"WITH t AS {_MIXED}, n AS (SELECT count(text) AS n FROM t), p AS (" + " UNION ALL ".join(f"SELECT '{k}' AS pattern, count(*) AS c, array_to_string(list_sort(list(DISTINCT text))[1:3], ' || ') AS examples FROM t WHERE {w}" for k, w in _PATTERNS.items()) + f") SELECT pattern, c AS count, {st('c * 100.0 / n')} AS pct, examples FROM p, n WHERE c > 0")
def text_patterns(s, d):
    return even(text.text_patterns(_mixed(s, d), "text"), "pct").withColumn("examples", F.array_join("examples", " || "))


@query(f"SELECT md5(text) AS digest, md5(array_to_string({_TOKENS.format(t='text')}, ' ')) AS words FROM {_MIXED} WHERE text IS NOT NULL")
def text_tokens(s, d):
    return _mixed(s, d).where("text is not null").select(F.md5("text").alias("digest"), F.md5(F.array_join(text.tokens(F.col("text")), " ")).alias("words"))


@query(rf"""
WITH r AS (SELECT length(regexp_replace(text, '\s', '', 'g')) AS n, length(regexp_replace(text, '[^a-zA-Z0-9]', '', 'g')) AS a, length(regexp_replace(text, '[^\x{{3040}}-\x{{30FF}}\x{{4E00}}-\x{{9FAF}}]', '', 'g')) AS j FROM {_VARIED} WHERE text IS NOT NULL),
s AS (SELECT n, a / greatest(n, 1) AS en, j / greatest(n, 1) AS ja FROM r),
l AS (SELECT CASE WHEN n = 0 THEN 'unknown' WHEN ja > 0.3 THEN 'japanese' WHEN en > 0.7 THEN 'english' WHEN ja > 0.1 AND en > 0.3 THEN 'mixed' ELSE 'other' END AS language,
 CASE WHEN n = 0 THEN 0 WHEN ja > 0.3 THEN least(ja * 2, 1) WHEN en > 0.7 THEN en WHEN ja > 0.1 AND en > 0.3 THEN 0.8 ELSE 0.5 END AS c FROM s)
SELECT language, count(*) AS count, {st('count(*) * 100.0 / (SELECT count(*) FROM l)')} AS pct, {st('avg(c)')} AS confidence FROM l GROUP BY 1""")
def language_detection(s, d):
    return even(text.language_detection(_varied(s, d), "text"), "pct", "confidence")


def in_japanese(words):
    """Each word in letters of one Japanese script, by its crc32."""
    script = F.crc32(words) % 3
    return F.when(script == 0, F.translate(words, _LATIN, _HIRAGANA)).when(script == 1, F.translate(words, _LATIN, _KANA)).otherwise(F.translate(words, _LATIN, _KANJI))


@query()
def japanese_words(s, d):
    """The words of all conversations, written in Japanese scripts without spaces, as cut by a lexicon that is learned from them."""
    spelled = F.array_join(F.transform(F.split(F.lower("text"), " "), in_japanese), "")
    return even(text.word_frequency(table(s, d, "conversations").select(spelled.alias("text")), "text", 200, japanese=True), "pct")


_CHAR_TYPES = {"hiragana": r"\x{3040}-\x{309F}", "katakana": r"\x{30A0}-\x{30FF}", "kanji": r"\x{4E00}-\x{9FAF}", "alphanumeric": "a-zA-Z0-9", "punctuation": r".,!?;:''\"()\[\]{}\-_/\\@#$%^&*+=<>|~`", "whitespace": r"\s"}


@query(
    "WITH t AS (SELECT sum(length(text)) AS n, "
    + ", ".join(f"sum(length(regexp_replace(text, '[^{p}]', '', 'g'))) AS {k}" for k, p in _CHAR_TYPES.items())
    + f" FROM {_MIXED}), c AS (SELECT n, unnest([{', '.join(repr(k) for k in (*_CHAR_TYPES, 'other'))}]) AS char_type, unnest([{', '.join(_CHAR_TYPES)}, n - {' - '.join(_CHAR_TYPES)}]) AS c FROM t) SELECT char_type, CAST(c AS BIGINT) AS count, {st('c * 100.0 / n')} AS pct FROM c WHERE c > 0"
)
def char_types(s, d):
    return even(text.char_types(_mixed(s, d), "text"), "pct")


@query(f"""
WITH s AS (SELECT unnest({_SENTENCES}) AS s FROM {_VARIED}), w AS (SELECT len({_TOKENS.format(t='s')}) AS w FROM s)
SELECT CASE WHEN w <= 5 THEN '0-5' WHEN w <= 10 THEN '6-10' WHEN w <= 20 THEN '11-20' WHEN w <= 30 THEN '21-30' ELSE '31+' END AS name, count(*) AS count, CAST(NULL AS DOUBLE) AS mean FROM w GROUP BY 1 UNION ALL SELECT 'sentences', count(*), {st('avg(w)')} FROM w""")
def sentence_lengths(s, d):
    return even(text.sentence_analysis(_varied(s, d), "text").where("kind <> 'mark'").select("name", "count", "mean"), "mean")


@query("WITH m AS (SELECT unnest(['.', ',', '!', '?', ';', ':']) AS name), c AS (SELECT name, CAST(sum(length(text) - length(replace(text, name, ''))) AS BIGINT) AS c FROM m, documents GROUP BY 1) SELECT name, c AS count FROM c WHERE c > 0")
def sentence_marks(s, d):
    return text.sentence_analysis(table(s, d, "documents"), "text").where("kind = 'mark'").select("name", "count")


@query(f"""
WITH a AS (SELECT sum(w) / sum(s) AS wps, sum(c) / sum(w) AS cpw FROM ({_MEASURED})), r AS (SELECT *, greatest(0, least(100, 100 - least(wps / 20, 1) * 40 - least((cpw - 3) / 5, 1) * 40)) AS sc FROM a),
v AS (SELECT *, list_filter([CASE WHEN wps > 20 THEN 'shorten sentences' END, CASE WHEN wps < 5 THEN 'join short sentences' END, CASE WHEN cpw > 8 THEN 'use shorter words' END, CASE WHEN sc < 40 THEN 'simplify' END], lambda x: x IS NOT NULL) AS r FROM r)
SELECT {st('sc')} AS score, CASE WHEN sc >= 80 THEN 'very easy' WHEN sc >= 60 THEN 'easy' WHEN sc >= 40 THEN 'normal' WHEN sc >= 20 THEN 'difficult' ELSE 'very difficult' END AS level, {st('wps')} AS words_per_sentence, {st('cpw')} AS chars_per_word,
 array_to_string(CASE WHEN len(r) = 0 THEN ['fine as it is'] ELSE r END, '; ') AS recommendations FROM v""")
def readability(s, d):
    return even(text.readability_report(_varied(s, d), "text").withColumn("recommendations", F.array_join("recommendations", "; ")), "score", "words_per_sentence", "chars_per_word")


@query("SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, row_number() OVER (ORDER BY event_id) AS _source_row_id, 'events' AS _source_table, 'props' AS _source_column FROM events")
def json_child_table(s, d):
    from ..sources.files import json_child_table as child

    return child(table(s, d, "events"), "events", "props", ["event_id"])


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS rows FROM {t}" for t in ("region", "nation", "customer", "orders")))
def union_counts(s, d):

    return reduce(DataFrame.unionAll, (table(s, d, t).agg(F.lit(t).alias("table_name"), F.count("*").alias("rows")) for t in ("region", "nation", "customer", "orders")))


@query("SELECT c_custkey AS key, c_acctbal AS balance, 'customer' AS source FROM customer UNION ALL SELECT s_suppkey, s_acctbal, 'supplier' FROM supplier")
def union_tagged(s, d):
    c = table(s, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"), F.lit("customer").alias("source"))
    return c.unionByName(table(s, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance"), F.lit("supplier").alias("source")))


@query("SELECT count(*) AS rows FROM (SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders)")
def count_distinct_rows(s, d):
    return table(s, d, "orders").select("o_orderstatus", "o_orderpriority").distinct().agg(F.count("*").alias("rows"))


_CHAIN = """WITH RECURSIVE n(k, total) AS (SELECT c_custkey, c_acctbal FROM {t} WHERE c_custkey = 0 UNION ALL SELECT c.c_custkey, n.total + c.c_acctbal FROM n JOIN {t} c ON c.c_custkey = n.k + 1 WHERE n.k < 60)"""


@query(_CHAIN.format(t="customer") + f" SELECT k, {st('total')} AS total FROM n")
def recursive_cte(s, d):
    """A running balance from customer to customer."""
    return even(s.sql(_CHAIN.format(t=f"parquet.`{d}/customer.parquet`") + " SELECT k, total FROM n"), "total")


@query("SELECT o_orderkey, o_totalprice FROM orders, (SELECT avg(o_totalprice) + 1.5 * stddev_samp(o_totalprice) AS t FROM orders) WHERE o_totalprice > t")
def crossjoin_threshold(s, d):
    o = table(s, d, "orders")
    limit = o.agg((F.avg("o_totalprice") + 1.5 * F.stddev_samp("o_totalprice")).alias("t"))
    return o.crossJoin(F.broadcast(limit)).where("o_totalprice > t").select("o_orderkey", "o_totalprice")


@query("SELECT n_name, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def sql_pass_through(s, d):
    q = f"SELECT n_name, count(*) AS orders FROM parquet.`{d}/orders.parquet` JOIN parquet.`{d}/customer.parquet` ON o_custkey = c_custkey JOIN parquet.`{d}/nation.parquet` ON c_nationkey = n_nationkey GROUP BY 1"
    return s.sql(q)


@query("SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id) - 1 AS row_index FROM events")
def row_index(s, d):
    return with_row_index(table(s, d, "events").select("event_id", "ts"), [F.desc("ts"), "event_id"]).select("event_id", "row_index")


_STREAMED = f"SELECT date_trunc('hour', ts) AS period, event_type, {st('avg(value)')} AS value, count(*) AS count FROM events GROUP BY 1, 2"


@query(_STREAMED)
def stream_window_counts(s, d):
    schema = table(s, d, "events").schema
    stream = s.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    out = monitor.run_to_end(monitor.window_counts(stream, "ts", "value", by=("event_type",)), "stream_window_counts")
    return even(out, "value")


@query("SELECT CAST(1 AS BIGINT) AS id, 'events' AS table_name, 'inserted' AS change_type, count(*) AS count FROM events WHERE event_id % 2 = 1")
def stream_monitor(s, d):
    events = table(s, d, "events")
    seen = [events.where("event_id % 2 = 0"), events]
    watch = monitor.Monitor(s)
    watch.subscribe("events", lambda: (seen.pop(0) if len(seen) > 1 else seen[0]).count())
    watch.check()
    return watch.notifications.frame(s).select("id", "table_name", "change_type", "count")


@query("""
WITH p AS (SELECT event_id % 3 AS batch, count(*) AS count FROM events GROUP BY 1), c AS (SELECT count(*) AS count FROM customer)
SELECT batch, 'events' AS table_name, 'inserted' AS change_type, count, CAST(sum(count) OVER (ORDER BY batch) AS BIGINT) AS total, batch = 1 AS acknowledged FROM p
UNION ALL SELECT 1, 'customers', 'inserted', count, count, false FROM c""")
def stream_durable_monitor(s, d):
    """Events arrive in three parts; the monitor stops after each and is opened anew, and once it has nothing new to tell."""
    folder, events = scratch_path(s, "monitor"), table(s, d, "events")
    watched = {"events": (f"{folder}/in/events", events.schema), "customers": (f"{folder}/in/customers", table(s, d, "customer").schema)}
    table(s, d, "customer").limit(0).write.parquet(f"{folder}/in/customers")
    for part in range(3):
        events.where(F.col("event_id") % 3 == part).write.mode("append").parquet(f"{folder}/in/events")
        if part == 1:
            table(s, d, "customer").write.mode("append").parquet(f"{folder}/in/customers")
        for _ in range(2):
            watch = monitor.DurableMonitor(s, folder)
            watch.catch_up(watched)
            watch.stop()
        if part == 1:
            watch.acknowledge(1, "events")
    return monitor.DurableMonitor(s, folder).notifications().drop("at")


@query("SELECT *, CAST(NULL AS VARCHAR) AS note FROM orders WHERE o_orderkey % 4 <> 3 UNION ALL SELECT *, 'late' FROM orders WHERE o_orderkey % 4 = 3")
def stored_table(s, d):
    """Orders put into a stored table part by part, by rows and by queries with parameters; read after the workspace was opened anew."""
    space = workspace.Workspace(s, scratch_path(s, "space"))
    source = f"orders_{uuid.uuid4().hex[:8]}"
    space.create(source, table(s, d, "orders"))
    name = space.create_as(f"stored_{uuid.uuid4().hex[:8]}", f"SELECT * FROM {source} WHERE o_orderkey % 4 = :part", part=0)
    space.insert(name, f"SELECT * FROM {source} WHERE o_orderkey % 4 = :part", part=1)
    space.insert(name, table(s, d, "orders").where("o_orderkey % 4 = 2"))
    space.insert(name, table(s, d, "orders").where("o_orderkey % 4 = 3").withColumn("note", F.lit("late")))
    space.save_manifest()
    return workspace.Workspace.reopen(space.folder, s).table(name)


@query("SELECT i AS id FROM range(1, 501) r(i)")
def simulated_table(s, d):
    return simulator.sample_table(s, 500).select("id")


# Values and labels.
_PRICE = "o_totalprice * 1e6 / 7.123457e0"
_TRIMMED = "regexp_replace({}, '\\.?0+$', '')"
_EXP = "regexp_replace(printf('%.{}e', {}), 'e([+-])0(\\d)$', 'e\\1\\2')"


@query(f"""
WITH x AS (SELECT o_orderkey AS id, unnest([{_PRICE}, o_totalprice / 7.123457e0, floor(o_totalprice), o_totalprice / 7.123457e7, o_totalprice / 7.123457e11, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderkey / 7.0e2 END]) AS v, unnest(range(6)) AS form FROM orders)
SELECT id, form, CASE WHEN v IS NULL THEN 'N/A' WHEN v >= 1e9 THEN {_EXP.format(2, 'v')} WHEN v > 0 AND v < 0.001 THEN {_EXP.format(3, 'v')}
  WHEN v = floor(v) THEN format('{{:,}}', CAST(v AS BIGINT)) WHEN v >= 1000 THEN {_TRIMMED.format("format('{:,.2f}', v)")}
  WHEN v >= 0.01 THEN {_TRIMMED.format("printf('%.4f', v)")} ELSE {_TRIMMED.format("printf('%.6f', v)")} END AS label FROM x""")
def number_labels(s, d):
    p, k = F.col("o_totalprice"), F.col("o_orderkey")
    values = F.array(p * 1e6 / 7.123457, p / 7.123457, F.floor(p).cast("double"), p / 7.123457e7, p / 7.123457e11, F.when(k % 9 != 0, k / 7.0e2))
    x = table(s, d, "orders").select(k.alias("id"), F.posexplode(values).alias("form", "v"))
    return x.select("id", F.col("form").cast("long").alias("form"), display.number_label(F.col("v")).alias("label"))


@query(r"""
WITH x AS (SELECT doc_id, n_chars * CASE doc_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2048 END AS b FROM documents),
s AS (SELECT doc_id, b, CASE WHEN b >= 1073741824 THEN 3 WHEN b >= 1048576 THEN 2 WHEN b >= 1024 THEN 1 ELSE 0 END AS i FROM x)
SELECT doc_id, CASE WHEN doc_id % 10 = 7 THEN 'サイズ不明' ELSE regexp_replace(CAST(round(b / pow(1024, i), 2) AS VARCHAR), '\.0$', '') || ' ' || ['Bytes', 'KB', 'MB', 'GB'][i + 1] END AS label FROM s""")
def size_labels(s, d):
    k = F.col("doc_id")
    size = F.col("n_chars") * F.when(k % 3 == 0, 0).when(k % 3 == 1, 1).otherwise(2048)
    return table(s, d, "documents").select("doc_id", display.bytes_label(F.when(k % 10 != 7, size)).alias("label"))


@query("SELECT printf('%.1f', l_quantity / 7) AS label, count(*) AS count FROM lineitem GROUP BY 1")
def fixed_decimals(s, d):
    return table(s, d, "lineitem").groupBy(display.fixed_text(F.col("l_quantity") / 7).alias("label")).agg(F.count("*").alias("count"))


@query("""
SELECT o_orderkey, CASE o_orderkey % 7 WHEN 6 THEN NULL ELSE epoch_ms(date_trunc('day', o_orderdate)) + CASE o_orderkey % 7 WHEN 1 THEN 45296000 WHEN 5 THEN 45296000 ELSE 0 END END AS ms, o_orderkey % 7 < 4 AS looks_like_date FROM orders""")
def date_forms(s, d):
    o, k, t = table(s, d, "orders"), F.col("o_orderkey") % 7, F.col("o_orderdate")
    forms = ("yyyy-MM-dd", "yyyy-MM-dd'T'12:34:56", "MM/dd/yyyy", "yyyy/MM/dd", "yyyy年M月d日", "yyyy年M月d日 12時34分56秒")
    written = F.coalesce(*(F.when(k == i, F.date_format(t, f)) for i, f in enumerate(forms)), F.lit("n/a"))
    return o.withColumn("written", written).select("o_orderkey", epoch_ms("written").alias("ms"), is_date("written").alias("looks_like_date"))


@query("SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN CAST(o_orderkey AS DOUBLE) WHEN 1 THEN o_orderkey * 100.0 WHEN 2 THEN -0.5 END AS value FROM orders")
def numbers_from_text(s, d):
    k = F.col("o_orderkey")
    text = F.when(k % 6 == 0, F.concat(F.lit(" "), k, F.lit(" "))).when(k % 6 == 1, F.concat(k, F.lit("e2"))).when(k % 6 == 2, "-.5").when(k % 6 == 3, F.concat(k, F.lit("px"))).when(k % 6 == 4, "1,000").otherwise("")
    o = table(s, d, "orders").select("o_orderkey", text.alias("written"))
    return o.select("o_orderkey", num(o, "written").alias("value"))


@query("SELECT CASE WHEN b < 0 THEN 'negative' WHEN b = 0 THEN 'zero' WHEN b <= 10 THEN 'low' WHEN b <= 100 THEN 'medium' WHEN b <= 1000 THEN 'high' ELSE 'very_high' END AS band, count(*) AS count FROM (SELECT floor(c_acctbal) AS b FROM customer) GROUP BY 1")
def size_bands(s, d):
    return table(s, d, "customer").groupBy(size_band(F.floor("c_acctbal")).alias("band")).agg(F.count("*").alias("count"))


@query("SELECT 'bin_' || CAST(least(floor((p_size - lo) / ((hi - lo) / 7)), 6) AS INTEGER) AS bin, count(*) AS count FROM part, (SELECT CAST(min(p_size) AS DOUBLE) AS lo, CAST(max(p_size) AS DOUBLE) AS hi FROM part) GROUP BY 1")
def equal_width_bins(s, d):
    part = table(s, d, "part").select(F.col("p_size").cast("double").alias("x"))
    ends = part.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    binned = part.crossJoin(F.broadcast(ends)).select(F.concat(F.lit("bin_"), equal_width_bin(F.col("x"), F.col("lo"), F.col("hi"), 7)).alias("bin"))
    return binned.groupBy("bin").agg(F.count("*").alias("count"))


@query(f"SELECT n_name, {st('coalesce(rich * 100.0 / nullif(debt, 0), 0)')} AS pct FROM (SELECT n_name, count(*) FILTER (WHERE c_acctbal > 5000) AS rich, count(*) FILTER (WHERE c_acctbal < -900) AS debt FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1)")
def safe_percentages(s, d):
    n = table(s, d, "nation").join(table(s, d, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    x = n.groupBy("n_name").agg(F.count_if(F.col("c_acctbal") > 5000).alias("rich"), F.count_if(F.col("c_acctbal") < -900).alias("debt"))
    return even(x.select("n_name", safe_percent(F.col("rich"), F.col("debt")).alias("pct")), "pct")


# Rows without a table, text of SQL, sorting and paging.
_RANKED = "VALUES ('1-URGENT', 1), ('2-HIGH', 2), ('3-MEDIUM', NULL), ('9-NONE', 9)"


@query(f"SELECT v.priority, v.weight, count(o_orderkey) AS orders FROM ({_RANKED}) v(priority, weight) LEFT JOIN orders ON o_orderpriority = v.priority GROUP BY 1, 2")
def values_scan(s, d):
    """Rows written out in the query, joined with orders."""
    counted = f"SELECT o_orderpriority, count(o_orderkey) AS n FROM parquet.`{d}/orders.parquet` GROUP BY 1"  # before the join, which would sort all rows of a value in one task
    return s.sql(f"SELECT v.priority, v.weight, coalesce(sum(n), 0) AS orders FROM {_RANKED} AS v(priority, weight) LEFT JOIN ({counted}) ON o_orderpriority = v.priority GROUP BY 1, 2")


@query("SELECT i AS quantity, count(l_quantity) AS lines FROM range(5, 61) r(i) LEFT JOIN lineitem ON CAST(l_quantity AS BIGINT) = i GROUP BY 1")
def range_scan(s, d):
    """A range of numbers, each with its lines, also where there are none."""
    counted = f"SELECT CAST(l_quantity AS BIGINT) AS i, count(l_quantity) AS n FROM parquet.`{d}/lineitem.parquet` GROUP BY 1"  # before the join, as in values_scan
    return s.sql(f"SELECT id AS quantity, coalesce(n, 0) AS lines FROM range(5, 61) LEFT JOIN ({counted}) ON i = id")


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%a%' AND p_brand NOT LIKE '%1%' ORDER BY p_partkey DESC LIMIT 40 OFFSET 10")
def sql_select_page(s, d):
    return s.sql(f"SELECT p_partkey, p_name FROM parquet.`{d}/part.parquet` WHERE p_name ILIKE '%a%' AND p_brand NOT LIKE '%1%' ORDER BY p_partkey DESC LIMIT 40 OFFSET 10")


_SOME = "SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END AS balance FROM customer ORDER BY balance {}, c_custkey LIMIT 25 OFFSET 25"


def _with_gaps(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")).alias("balance"))


@query(_SOME.format("DESC NULLS FIRST"))
def result_page_descending(s, d):
    return preview.page(preview.sort_rows(_with_gaps(s, d), "balance", True, then=["c_custkey"], nulls="result"), 2, 25)


@query(_SOME.format("ASC NULLS LAST"))
def result_page_ascending(s, d):
    return preview.page(preview.sort_rows(_with_gaps(s, d), "balance", then=["c_custkey"], nulls="result"), 2, 25)


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y年%-m月%-d日') AS day FROM orders ORDER BY date_trunc('day', o_orderdate), o_orderkey LIMIT 50")
def preview_dates_in_text(s, d):
    o = table(s, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy年M月d日").alias("day"))
    return preview.page(preview.sort_rows(o, "day", kind="DATE", then=["o_orderkey"]), 1, 50)


@query(_UNIFORM.format(k="event_id", m=1500) + " SELECT event_id, row_index FROM p")
def sample_for_time_series(s, d):
    return sampling.sample_for("timeseries", table(s, d, "events").select("event_id"), ["event_id"])


# Files: written, loaded by the workspace as a user would, and read back.
def _reloaded(s: SparkSession, df: DataFrame, kind: str) -> DataFrame:
    path = scratch_path(s, f"copy.{kind}")
    space = workspace.Workspace(s)
    if kind == "sqlite":
        workspace.write(df, path.removeprefix("file:"), kind)
        path = path.removeprefix("file:")
    elif kind == "tsv":
        df.write.option("header", True).option("sep", "\t").csv(path)
    else:
        workspace.write(df, path, kind)
    return databases.read_table(s, path, "data") if kind == "sqlite" else space.table(space.load(path, f"copy_{uuid.uuid4().hex[:8]}", children=False)[0])


_AS_TEXT = "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name || ', \"' || n_name || '\"' AS name, CASE WHEN n_regionkey > 0 THEN CAST(n_regionkey AS VARCHAR) END AS region FROM nation"


def _nations(s: SparkSession, d: str) -> DataFrame:
    name = F.col("n_name")
    return table(s, d, "nation").select("n_nationkey", F.concat(name, F.lit(', "'), name, F.lit('"')).alias("name"), F.when(F.col("n_regionkey") > 0, F.col("n_regionkey")).alias("region"))


@query(_AS_TEXT)
def csv_round_trip(s, d):
    return _reloaded(s, _nations(s, d), "csv")


@query(_AS_TEXT.replace("', \"' || n_name || '\"'", "' it'"))
def tsv_round_trip(s, d):
    return _reloaded(s, _nations(s, d).withColumn("name", F.regexp_replace("name", ",.*", " it")), "tsv")


@query("SELECT c_custkey, c_name, c_acctbal, c_custkey % 2 = 0 AS even FROM customer")
def parquet_round_trip(s, d):
    return _reloaded(s, table(s, d, "customer").select("c_custkey", "c_name", "c_acctbal", (F.col("c_custkey") % 2 == 0).alias("even")), "parquet")


@query("SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END AS balance FROM customer")
def sqlite_round_trip(s, d):
    return _reloaded(s, table(s, d, "customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")).alias("balance")), "sqlite")


def _written(s: SparkSession, name: str, rows: list[str], encoding: str = "utf-8") -> str:
    """A small file of our own making, in the shared folder."""
    path = scratch_path(s, name)
    jvm = s.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(s.sparkContext._jsc.hadoopConfiguration()).create(at)
    out.write(bytearray("\n".join(rows).encode(encoding)))
    out.close()
    return path


def _loaded(s: SparkSession, path: str, **options) -> DataFrame:
    space = workspace.Workspace(s)
    return space.table(space.load(path, f"own_{uuid.uuid4().hex[:8]}", children=False, **options)[0])


@query("""
SELECT CASE WHEN c_custkey % 6 = 1 THEN NULL ELSE CAST(c_custkey AS VARCHAR) END AS a,
 CASE c_custkey % 6 WHEN 1 THEN NULL WHEN 3 THEN NULL WHEN 4 THEN c_name || ', "' || c_mktsegment || '"' ELSE c_name END AS b FROM customer WHERE c_custkey % 6 <> 5""")
def csv_odd_lines(s, d):
    """Customers as lines of six kinds: cells with space around them, rows of empty cells, cells beyond the header, short rows, quotes and commas in cells, and blank lines, which alone are no rows."""
    k, name = F.col("c_custkey"), F.col("c_name")
    plain = F.concat_ws(",", k, name)
    kinds = [F.concat(F.lit(" "), F.concat_ws(" , ", k, name), F.lit("  ")), F.lit(","), F.concat(plain, F.lit(",9")), k.cast("string"), F.concat(k, F.lit(',"'), name, F.lit(', ""'), "c_mktsegment", F.lit('"""')), F.lit("   ")]
    line = F.element_at(F.array(*kinds), (k % 6 + 1).cast("int"))
    return _loaded(s, _written_lines(s, "odd.csv", "a,b", table(s, d, "customer").select(k.alias("at"), line.alias("line"))))


#: Lines of each file that ``_written_lines`` makes.
PART = 500_000


def _written_lines(s: SparkSession, name: str, header: str | None, lines: DataFrame, encoding: str = "utf-8", mark: str = "", every: bool = True) -> str:
    """A line for each row of (at, line), in that order, in an encoding, written by Spark, which passes bytes on.

    The lines go to a folder of files of about ``PART`` lines each, which follow each other by name. The header stands in
    each of them, or in the first alone.
    """
    path = scratch_path(s, name)

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = header is not None and every
        for pdf in batches:
            values = [t.encode(encoding) for t in pdf["line"]]
            if first and values:
                values, first = ([] if pdf["at"].iloc[0] == -1 else [(mark + header).encode(encoding)]) + values, False
            yield pd.DataFrame({"value": values})

    rows = lines if header is None else s.createDataFrame([(-1, mark + header)], "at long, line string").unionAll(lines)
    parts = rows.repartitionByRange(-(-lines.count() // PART) or 1, "at").sortWithinPartitions("at")
    parts.mapInPandas(encoded, "value binary").select(F.col("value").cast("string")).write.text(path)
    return path


_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_ACCENTED = "ÀBÇDÉFGHÎJKLMÑÖPQRŠTÜVWXŸŽ"


def _in_encoding(letters: str, encoding: str, named: str | None = None, mark: str = "") -> Query:
    def load(s: SparkSession, d: str) -> DataFrame:
        """Customers with their segment in other letters, written in an encoding and loaded; unless it is named, it is found."""
        line = F.concat_ws(",", "c_custkey", F.translate("c_mktsegment", _CAPITALS, letters), F.concat(F.lit('"'), "c_name", F.lit(', "'), F.lit('"'), "c_nationkey", F.lit('"""')))
        path = _written_lines(s, f"{encoding}.csv", "番号,segment,name" if letters == _KANA else "number,segment,name", table(s, d, "customer").select(F.col("c_custkey").alias("at"), line.alias("line")), encoding, mark)
        found = _loaded(s, path, **({"encoding": named} if named else {}))
        return found.toDF("number", "segment", "name")

    return load


for _code, _letters, _named, _mark in (("shift_jis", _KANA, None, ""), ("euc_jp", _KANA, None, ""), ("iso2022_jp", _KANA, None, ""), ("utf-8-sig", _KANA, None, ""), ("cp1252", _ACCENTED, "cp1252", "")):
    _file = {"utf-8-sig": "utf-8"}.get(_code, _code)
    query(f"""SELECT CAST(c_custkey AS VARCHAR) AS number, translate(c_mktsegment, '{_CAPITALS}', '{_letters}') AS segment, c_name || ', "' || c_nationkey || '"' AS name FROM customer""", f"csv_{_code.replace('-', '_')}")(
        _in_encoding(_letters, _file, _named, "\ufeff" if _code == "utf-8-sig" else "")
    )


@query(f"SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, translate(c_mktsegment, '{_CAPITALS}', '{_KANA}') AS segment FROM customer")
def csv_utf_16(s, d):
    path = scratch_path(s, "utf16.csv")
    rows = table(s, d, "customer").select("c_custkey", F.translate("c_mktsegment", _CAPITALS, _KANA).alias("segment"))
    rows.coalesce(1).write.option("header", True).option("encoding", "UTF-16LE").csv(path)
    return _loaded(s, path)


@query("SELECT encoding, count(*) AS rows FROM (VALUES ('shift_jis'), ('euc_jp'), ('iso2022_jp'), ('utf-8')) v(encoding), customer GROUP BY 1")
def encoding_detection(s, d):
    """What the detector says of customers' names with Japanese words around them, in several encodings; and the lines of each."""
    from ..sources import encoding, files

    line = F.concat(F.lit("東京の人は"), "c_name", F.lit("が好きです,"), F.translate("c_mktsegment", _CAPITALS, _KANA))
    lines = table(s, d, "customer").select(F.col("c_custkey").alias("at"), line.alias("line"))
    found = []
    for e in ("shift_jis", "euc_jp", "iso2022_jp", "utf-8"):
        path = _written_lines(s, f"{e}.txt", None, lines, e)
        name = encoding.detect(files.head(s, path)).encoding
        found.append(files.decoded_lines(s, path, name).where(F.col("value").contains("の人は")).agg(F.lit(name).alias("encoding"), F.count("*").alias("rows")))
    return reduce(DataFrame.unionAll, found)


_JSON_ORDERS = """
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_totalprice AS VARCHAR) AS price, CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END AS even, CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus || ' "[{,\\' END AS status,
 CASE WHEN o_orderkey % 5 > 0 THEN '{"priority":"' || o_orderpriority || '","keys":[' || o_orderkey || ',' || o_custkey || ']}' END AS nested, CASE WHEN o_orderkey = (SELECT max(o_orderkey) FROM orders) THEN 'here' END AS a_late_one FROM orders"""


@query(_JSON_ORDERS)
def json_load(s, d):
    """Orders as one JSON document on a single line but for its elements, with brackets and quotes in texts and a key that only the last one has."""
    o = table(s, d, "orders")
    last = o.agg(F.max("o_orderkey")).first()[0]
    k = F.col("o_orderkey")
    nested = F.when(k % 5 > 0, F.struct(F.col("o_orderpriority").alias("priority"), F.array("o_orderkey", "o_custkey").alias("keys")))
    text_of = F.when(k % 3 > 0, F.concat("o_orderstatus", F.lit(' "[{,\\')))
    object_of = F.to_json(F.struct(k, F.format_string("%.2f", "o_totalprice").cast("decimal(12,2)").alias("price"), (k % 2 == 0).alias("even"), text_of.alias("status"), nested.alias("nested"), F.when(k == last, "here").alias("a_late_one")))
    lines = o.select(k.alias("at"), F.concat(object_of, F.when(k == last, "]").otherwise(",")).alias("line"))
    return _loaded(s, _written_lines(s, "orders.json", "[", lines, every=False), parts=True).withColumn("price", F.col("price").cast("double").cast("string"))


@query("SELECT n_nationkey + 1 AS _source_row_id, n_nationkey AS k, n_name AS name FROM nation WHERE n_nationkey % 3 <> 0")
def json_children_in_file_order(s, d):
    """Objects in a text column as a table; their row numbers are those of the file, which isn't in the order of its values."""
    rows = [[r.n_nationkey, r.n_name] for r in table(s, d, "nation").orderBy("n_nationkey").select("n_nationkey", "n_name").collect()]  # 25 rows
    lines = [f"{99 - k};" + (f'"{{""k"": {k}, ""name"": ""{n}""}}"' if k % 3 else "none") for k, n in rows]
    space, name = workspace.Workspace(s), f"own_{uuid.uuid4().hex[:8]}"
    children = space.load(_written(s, "children.csv", ["at;props", *lines]), name, sep=";")[1:]
    return space.table(children[0]).select("_source_row_id", "k", "name")


@query("SELECT n_nationkey, n_name, n_regionkey * 1.5 AS share, n_nationkey % 2 = 0 AS even, TIMESTAMP '2024-01-01 00:00:00' + to_days(n_nationkey) AS at FROM nation")
def csv_typed(s, d):
    from ..sources import files

    at = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(n_nationkey)")
    rows = table(s, d, "nation").select("n_nationkey", "n_name", (F.col("n_regionkey") * 1.5).alias("share"), (F.col("n_nationkey") % 2 == 0).alias("even"), F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("at"))
    path = scratch_path(s, "typed.csv")
    workspace.write(rows, path, "csv")
    typed = files.read_csv_auto(s, path)
    return typed.withColumn("at", F.col("at").cast("timestamp_ntz"))


@query("SELECT n_nationkey AS k, n_name AS name, CASE WHEN n_nationkey = 3 THEN 'three' ELSE CAST(n_nationkey AS VARCHAR) END AS odd, n_nationkey * 0.5 AS half FROM nation")
def sqlite_dynamic_types(s, d):
    """A table without row ids, with text in a column that is declared INTEGER."""
    import sqlite3

    path = scratch_path(s, "dynamic.sqlite").removeprefix("file:")
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE t (k INTEGER PRIMARY KEY, name TEXT, odd INTEGER, half REAL) WITHOUT ROWID")
    con.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", [(r.n_nationkey, r.n_name, "three" if r.n_nationkey == 3 else r.n_nationkey, r.n_nationkey * 0.5) for r in table(s, d, "nation").collect()])  # 25 rows
    con.commit()
    con.close()
    return databases.read_table(s, path, "t")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def duckdb_file(s, d):
    import duckdb

    path = scratch_path(s, "own.duckdb").removeprefix("file:")
    con = duckdb.connect(path)
    con.execute(f"CREATE TABLE nations AS SELECT n_nationkey, n_name, n_regionkey FROM '{d.removeprefix('file:')}/nation.parquet'")
    con.close()
    space = workspace.Workspace(s)
    return space.table(space.load(path)[0]).select(F.col("n_nationkey").cast("int"), "n_name", F.col("n_regionkey").cast("int"))


@query("SELECT * FROM (VALUES ('after insert', CAST(26 AS BIGINT)), ('with a new column', 1), ('after drop', 0)) v(step, rows)")
def catalog_steps(s, d):
    """Rows put in, one of them with a column of its own; then the table goes."""
    space = workspace.Workspace(s)
    name = space.create(f"steps_{uuid.uuid4().hex[:8]}", table(s, d, "nation"))
    space.insert(name, s.createDataFrame([(99, "NOWHERE", "x")], "n_nationkey int, n_name string, note string"))
    found = [("after insert", space.count(name)), ("with a new column", space.count(name, [Filter("note", "is_not_null")]))]
    space.drop(name)
    return s.createDataFrame([*found, ("after drop", int(name in space.tables()))], "step string, rows long")


@query("SELECT c_custkey, c_custkey % 4 = 0 OR c_custkey % 4 = 1 OR c_custkey % 4 = 3 AS missing FROM customer")
def missing_zero_and_blank(s, d):
    """The text 0, blanks and nulls are missing; the text 0.0 isn't."""
    k = F.col("c_custkey") % 4
    v = F.when(k == 0, "0").when(k == 1, " ").when(k == 2, "0.0")
    return table(s, d, "customer").select("c_custkey", missing.is_missing(v).alias("missing"))


@query("SELECT f AS form, is_date, count(*) AS rows FROM (SELECT o_orderkey % 6 AS f, o_orderkey % 6 <> 4 AS is_date FROM orders) GROUP BY 1, 2")
def date_starts(s, d):
    """Orders' dates written in six ways, of which one is no date."""
    at = F.col("o_orderdate")
    forms = [F.date_format(at, x) for x in ("yyyy-MM-dd", "MM/dd/yyyy", "yyyy/MM/dd", "' 'yyyy-MM-dd", "yyyyMMdd", "yyyy-MM-dd'x'")]
    written = F.element_at(F.array(*forms), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return table(s, d, "orders").select((F.col("o_orderkey") % 6).alias("form"), is_date(written).alias("is_date")).groupBy("form", "is_date").agg(F.count("*").alias("rows"))


_DEEP = "WITH RECURSIVE c(i, top) AS (SELECT CAST(1 AS BIGINT), (SELECT max(c_custkey) FROM {t}) UNION ALL SELECT i + 1, top FROM c WHERE i < least(top, 1000)) SELECT count(*) AS rows, CAST(sum(i) AS BIGINT) AS total, max(top) AS top FROM c"


@query(_DEEP.format(t="customer"))
def recursive_cte_deep(s, d):
    """As many steps as customers, up to a thousand: more than the session allows by itself."""
    key = "spark.sql.cteRecursionLevelLimit"
    before = s.conf.get(key)
    s.conf.set(key, "2000")
    try:
        found = s.sql(_DEEP.format(t=f"parquet.`{d}/customer.parquet`")).collect()  # one row
    finally:
        s.conf.set(key, before)
    return s.createDataFrame(found, "rows long, total long, top long")


@query("SELECT l_shipmode_like AS item, count(*) AS count FROM (SELECT 'l_returnflag=' || l_returnflag AS l_shipmode_like FROM lineitem UNION ALL SELECT 'l_linestatus=' || l_linestatus FROM lineitem) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def top_items(s, d):
    """The most frequent column=value items."""
    cells = F.array(*(F.concat_ws("=", F.lit(c), F.col(c)) for c in ("l_returnflag", "l_linestatus")))
    return table(s, d, "lineitem").select(F.explode(cells).alias("item")).groupBy("item").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "item").limit(20)


@query(ORACLE_SQL["basic_stats"])
def analysis_basic(s, d):
    """An analysis by its name, over filtered rows."""
    return even(analysis.analyse(table(s, d, "lineitem"), "basic", _NUMBERS, _RETURNED)["statistics"], "mean", "std")


@query(ORACLE_SQL["word_frequency"].replace("LIMIT 20", "LIMIT 15"))
def analysis_text_words(s, d):
    """The words of the text analysis, which shows fifteen."""
    return even(analysis.analyse(table(s, d, "documents"), "text", ["text"])["words"], "pct")


@query("SELECT count(*) AS rows, count(*) AS ids, count(*) AS well_formed FROM nation")
def generated_ids(s, d):
    """A random identifier for each row: all of them different and well formed."""
    rows = table(s, d, "nation").select(F.uuid().alias("id"))
    form = "^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
    return rows.agg(F.count("*").alias("rows"), F.count_distinct("id").alias("ids"), F.count_if(F.col("id").rlike(form)).alias("well_formed"))


def _analysed(name: str, oracle: str, run: Query) -> None:
    """An analysis by its name gives what its own function gives."""
    query(ORACLE_SQL[oracle], f"analysis_{name}")(run)


_analysed("correlation", "correlation_matrix", lambda s, d: even(analysis.analyse(table(s, d, "lineitem"), "correlation", _NUMBERS)["pairs"], "correlation"))
_analysed("changepoint", "changepoint_moving_average", lambda s, d: even(analysis.analyse(_stepped(s, d), "changepoint", ["value"], order_by=["event_id"])["points"], "value", "confidence"))
_analysed("histogram", "histogram", lambda s, d: even(analysis.analyse(table(s, d, "orders"), "histogram", ["o_totalprice"])["bins"], "low", "high"))
_analysed("timeseries", "timeseries_trend", lambda s, d: even(analysis.analyse(table(s, d, "events"), "timeseries", ["value"], order_by=["event_id"], x="ts")["series"], "moving_average", "trend").drop("x"))
_analysed("missing", "missing_stats", lambda s, d: even(analysis.analyse(_gappy(s, d), "missing", ["a", "b"], order_by=["event_id"])["columns"], "avg_length", "missing_pct"))
_analysed("missing_events", "missing_events", lambda s, d: analysis.analyse(_gappy(s, d), "missing", ["a", "b"], order_by=["event_id"])["events"])
_analysed("association", "association_itemsets", lambda s, d: even(analysis.analyse(table(s, d, "orders"), "association", _ITEMS, min_support=0.05)["itemsets"].withColumn("items", F.array_join("items", "|")), "support"))
_analysed("mutual", "mutual_information_summary", lambda s, d: even(analysis.analyse(table(s, d, "lineitem"), "mutual", ["l_returnflag", "l_linestatus"])["summary"], "mean", "max", "min"))
_analysed("canonical", "canonical_correlation_single", lambda s, d: even(analysis.analyse(table(s, d, "lineitem"), "canonical", ["l_quantity", "l_extendedprice"])["correlations"].select("pair", "correlation", "wilks"), "correlation", "wilks"))
_analysed("column", "column_top_values", lambda s, d: even(analysis.analyse(table(s, d, "orders"), "column", ["o_orderstatus", "o_orderpriority"], order_by=["o_orderkey"])["top_values"], "pct"))
_analysed("text_statistics", "text_statistics", lambda s, d: even(analysis.analyse(_varied(s, d), "text", ["text"])["statistics"], *_SHARES))
_analysed("text_languages", "language_detection", lambda s, d: even(analysis.analyse(_varied(s, d), "text", ["text"])["languages"], "pct", "confidence"))
_analysed("text_patterns", "text_patterns", lambda s, d: even(analysis.analyse(_mixed(s, d), "text", ["text"])["patterns"], "pct").withColumn("examples", F.array_join("examples", " || ")))


@query(f"""
WITH c AS (SELECT var_pop(l_quantity) AS a, var_pop(l_extendedprice) AS b, covar_pop(l_quantity, l_extendedprice) AS c FROM lineitem),
e AS (SELECT (a + b) / 2 + sqrt(((a - b) / 2) ** 2 + c * c) AS l1, (a + b) / 2 - sqrt(((a - b) / 2) ** 2 + c * c) AS l2 FROM c)
SELECT CAST(f AS INTEGER) AS factor, column_name, {st('CASE WHEN f = 1 THEN l1 ELSE l2 END * 100 / (l1 + l2)')} AS share FROM e, range(1, 3) r(f), (VALUES ('l_quantity'), ('l_extendedprice')) v(column_name)""")
def pca_two_columns(s, d):
    """Two columns, whose factors' shares follow from their correlation."""
    return even(multivariate.pca(table(s, d, "lineitem"), ["l_quantity", "l_extendedprice"]).select("factor", "column_name", "share"), "share")


@query("SELECT column1, value1, column2, value2, count FROM (SELECT 'l_returnflag' AS column1, l_returnflag AS value1, 'l_linestatus' AS column2, l_linestatus AS value2, count(*) AS count FROM lineitem GROUP BY 2, 4) ORDER BY count DESC, value1, value2 LIMIT 5")
def top_pairs(s, d):
    """The five most frequent pairs of values of two columns."""
    pairs = table(s, d, "lineitem").groupBy(F.lit("l_returnflag").alias("column1"), F.col("l_returnflag").alias("value1"), F.lit("l_linestatus").alias("column2"), F.col("l_linestatus").alias("value2"))
    return pairs.agg(F.count("*").alias("count")).orderBy(F.desc("count"), "value1", "value2").limit(5)


# What a user types and edits.
@query("SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders WHERE o_totalprice >= 150000.5 AND o_orderpriority IN ('1-URGENT', '5-LOW') AND o_custkey < 100")
def filter_list_edited(s, d):
    """Filters that were typed as text, then changed, switched off and removed."""
    from ..operators.filters import FilterList, coerce_list, coerce_value, operators_for

    o = table(s, d, "orders")
    typed = lambda c, op, text: Filter(c, op, coerce_value(text, o.schema[c].dataType)) if op in operators_for(o.schema[c].dataType) else None
    edited = FilterList()
    for f in (typed("o_totalprice", "greater_equal", "99"), typed("o_custkey", "less_than", "100"), typed("o_orderstatus", "equals", "F"), typed("o_orderkey", "equals", "7"), typed("o_totalprice", "contains", "9")):
        if f is not None:
            edited.add(f)
    edited.add(Filter("o_orderpriority", "in", values=coerce_list("1-URGENT, 5-LOW,", o.schema["o_orderpriority"].dataType)))
    edited.update(0, value=coerce_value("150000.5", o.schema["o_totalprice"].dataType))
    edited.toggle(2)
    edited.remove(3)
    return apply_filters(o, edited.filters).select("o_orderkey", "o_totalprice", "o_orderpriority")


@query("SELECT c_custkey, c_name AS name, c_custkey || '-' || (c_custkey + 5) AS span FROM customer")
def trimmed_names(s, d):
    """Names with white space of several scripts around them, and ranges of numbers as labels."""
    from ..functions.coerce import trim_text

    k = F.col("c_custkey")
    around = F.element_at(F.array(*(F.lit(x) for x in (" ", "\u3000", "\u00a0\t", "\ufeff", "\r\n", "\u2003"))), (k % 6 + 1).cast("int"))
    rows = table(s, d, "customer").withColumn("name", F.concat(around, "c_name", around, F.lit("\n")))
    return rows.select("c_custkey", trim_text(F.col("name")).alias("name"), F.concat(k, F.lit("-"), k + 5).alias("span"))


@query("SELECT n_nationkey AS k, n_name AS name, n_regionkey / 2 AS half, n_regionkey = 1 AS first, CASE WHEN n_nationkey = 3 THEN 'three' ELSE CAST(n_nationkey AS VARCHAR) END AS mixed, CASE WHEN n_nationkey > 5 THEN n_nationkey END AS late FROM nation")
def objects_as_table(s, d):
    """Python objects, of which some lack a key and one column holds numbers and text."""
    from ..sources import files

    rows = table(s, d, "nation").collect()  # 25 rows
    objects = [{"k": r.n_nationkey, "name": r.n_name, "half": r.n_regionkey / 2, "first": r.n_regionkey == 1, "mixed": "three" if r.n_nationkey == 3 else r.n_nationkey} | ({"late": r.n_nationkey} if r.n_nationkey > 5 else {}) for r in rows]
    return files.table_from_objects(s, objects)


@query("SELECT * FROM (SELECT 'customer_' || unnest(['c_custkey', 'c_name', 'c_acctbal']) AS col_name, unnest(['bigint', 'string', 'double']) AS data_type), (SELECT count(*) AS rows FROM customer)")
def catalog_columns(s, d):
    """A workspace's table as the catalog describes it, with its rows."""
    space = workspace.Workspace(s)
    name = space.create(f"customers_{uuid.uuid4().hex[:8]}", table(s, d, "customer").select(*(F.col(c).alias(f"customer_{c}") for c in ("c_custkey", "c_name", "c_acctbal"))))
    found = space.sql(f"DESCRIBE {name}").select("col_name", "data_type").crossJoin(space.sql(f"SELECT count(*) AS rows FROM {name}"))  # one row
    assert name in space.tables()
    return found


@query("SELECT column_name, inferred_type FROM (VALUES ('whole', 'INTEGER'), ('price', 'FLOAT'), ('either', 'NUMERIC'), ('day', 'DATE'), ('even', 'BOOLEAN'), ('word', 'TEXT')) v(column_name, inferred_type) WHERE (SELECT count(*) FROM orders) > 0")
def infer_types_of_all_rows(s, d):
    """Types that four fifths of all rows look like, with other values among them."""
    k = F.col("o_orderkey")
    odd = lambda x, other: F.when(k % 10 == 3, other).otherwise(x)
    price = F.format_string("%.2f", "o_totalprice")
    rows = table(s, d, "orders").select(
        odd(k.cast("string"), "none").alias("whole"), odd(price, "-").alias("price"), F.when(k % 2 == 0, k.cast("string")).otherwise(price).alias("either"),
        odd(F.date_format("o_orderdate", "yyyy/MM/dd"), "soon").alias("day"), odd(F.when(k % 2 == 0, "true").otherwise("false"), "maybe").alias("even"), F.col("o_orderpriority").alias("word"),
    )
    return profile.infer_types(rows, rows.columns, sample_rows=None)

