"""Principal components and canonical correlation: one aggregation, then linear algebra on a small matrix."""

from __future__ import annotations

from collections.abc import Sequence
from math import erfc, exp, sqrt

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.coerce import num
from .filters import Filter, apply_filters


def covariances(df: DataFrame, values: dict[str, Column], filters: Sequence[Filter] | None = None) -> tuple[np.ndarray, int]:
    """The sample covariance matrix of the values and the number of rows, from a single aggregation."""
    names = list(values)
    x = apply_filters(df, filters).select(*(v.alias(f"v{i}") for i, v in enumerate(values.values()))).dropna()
    at = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    row = x.agg(F.count("*"), *(F.covar_samp(f"v{i}", f"v{j}") for i, j in at)).first()
    out = np.zeros((len(names), len(names)))
    for (i, j), c in zip(at, row[1:], strict=True):
        out[i, j] = out[j, i] = c if c is not None else 0.0
    return out, row[0]


def pca_variance_sql(df: DataFrame, columns: Sequence[str], factors: int = 2, filters: Sequence[Filter] | None = None) -> DataFrame:
    """(factor, column_name, eigenvalue, share, cumulative): the columns' variances taken for eigenvalues, largest first."""
    pairs = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"v{i}").alias("eigenvalue")) for i, c in enumerate(columns)))
    wide = apply_filters(df, filters).agg(*(F.var_pop(num(df, c)).alias(f"v{i}") for i, c in enumerate(columns)))
    v = wide.select(F.inline(pairs))
    order = Window.orderBy(F.desc("eigenvalue"), "column_name")
    share = F.coalesce(F.try_divide(F.col("eigenvalue"), F.sum("eigenvalue").over(Window.partitionBy())), F.lit(0.0)) * 100
    ranked = v.withColumn("factor", F.row_number().over(order)).withColumn("share", share)
    return ranked.withColumn("cumulative", F.sum("share").over(order.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("factor") <= factors).select("factor", "column_name", "eigenvalue", "share", "cumulative")


def pca(df: DataFrame, columns: Sequence[str], factors: int | None = None, filters: Sequence[Filter] | None = None) -> DataFrame:
    """(factor, eigenvalue, share, cumulative, column_name, loading) of the covariance matrix; the largest loading is positive."""
    c, _ = covariances(df, {x: num(df, x) for x in columns}, filters)
    w, v = np.linalg.eigh(c)
    order = np.argsort(-w, kind="stable")[: factors or len(columns)]
    total, rows, run = max(w.sum(), 1e-300), [], 0.0
    for k, i in enumerate(order):
        vec = v[:, i] * (np.sign(v[np.abs(v[:, i]).argmax(), i]) or 1)
        run += w[i] / total * 100
        rows += [(k + 1, float(w[i]), float(w[i] / total * 100), float(run), x, float(a)) for x, a in zip(columns, vec, strict=True)]
    return df.sparkSession.createDataFrame(rows, "factor int, eigenvalue double, share double, cumulative double, column_name string, loading double")


def _value(df: DataFrame, c: str, missing: str) -> Column:
    v = num(df, c)
    if isinstance(df.schema[c].dataType, T.StringType):
        v = F.coalesce(v, F.regexp_replace(F.col(f"`{c}`"), r"[^0-9.\-]", "").try_cast("double"))
    return F.coalesce(v, F.lit(0.0)) if missing == "zero" else v


def _tail(x: float, df: int) -> float:
    """The upper tail of chi-squared, by Wilson and Hilferty's cube root."""
    if x <= 0 or df <= 0:
        return 1.0
    z = ((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / sqrt(2 / (9 * df))
    return erfc(z / sqrt(2)) / 2


def canonical_correlation(df: DataFrame, left: Sequence[str], right: Sequence[str], filters: Sequence[Filter] | None = None, missing: str = "zero") -> DataFrame:
    """(pair, correlation, eigenvalue, share, cumulative, wilks, chi_squared, p_value_approx, p_value, left, right).

    ``left`` and ``right`` are the coefficients as maps from column to number. There are as many pairs as left columns.
    Fewer than three rows, or columns that depend on each other, are an error. ``p_value_approx`` is exp(-x / 2).
    """
    names = [*left, *right]
    c, n = covariances(df, {f"{i}:{x}": _value(df, x, missing) for i, x in enumerate(names)}, filters)
    if n < 3:
        raise ValueError("canonical correlation takes three rows or more")
    p, q = len(left), len(right)
    scale = np.sqrt(np.diag(c))
    c = c / np.outer(np.where(scale > 0, scale, 1), np.where(scale > 0, scale, 1))  # units don't matter
    xx, yy, xy = c[:p, :p], c[p:, p:], c[:p, p:]
    for m in (xx, yy):
        if np.linalg.matrix_rank(m, tol=1e-10) < len(m):
            raise ValueError("the columns of one side depend on each other")
    w, v = np.linalg.eig(np.linalg.solve(xx, xy) @ np.linalg.solve(yy, xy.T))
    order = np.argsort(-w.real, kind="stable")
    lam = np.clip(w.real[order], 0, 1)
    rho, total, run, rows = np.sqrt(lam), max(lam.sum(), 1e-300), 0.0, []
    for i, k in enumerate(order):
        a = v.real[:, k]
        a = a / max(sqrt(a @ xx @ a), 1e-300) * (np.sign(a[np.abs(a).argmax()]) or 1)
        b = np.linalg.solve(yy, xy.T @ a) / max(rho[i], 1e-300)
        wilks = float(np.prod(1 - lam[i:]))
        chi = float(-(n - 1 - (p + q + 1) / 2) * np.log(max(wilks, 1e-300)))
        run += lam[i] / total * 100
        rough = 1.0 if chi < 0 else 0.0 if chi > 50 else exp(-chi / 2)
        a, b = a / scale[:p], b / scale[p:]
        rows.append((i + 1, float(rho[i]), float(lam[i]), float(lam[i] / total * 100), float(run), wilks, chi, rough, _tail(chi, (p - i) * (q - i)), dict(zip(left, map(float, a), strict=True)), dict(zip(right, map(float, b), strict=True))))
    return df.sparkSession.createDataFrame(rows, "pair int, correlation double, eigenvalue double, share double, cumulative double, wilks double, chi_squared double, p_value_approx double, p_value double, left map<string,double>, right map<string,double>")


def canonical_loadings(result: DataFrame) -> DataFrame:
    """(pair, side, column_name, coefficient)."""
    one = lambda s: result.select("pair", F.lit(s).alias("side"), F.explode(s).alias("column_name", "coefficient"))
    return one("left").unionByName(one("right"))
