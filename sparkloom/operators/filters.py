"""A composable predicate builder: filters are data, compiled to one Column."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASE = ("equals", "not_equals", "is_null", "is_not_null")
NUMERIC = ("greater_than", "less_than", "greater_equal", "less_equal", "in", "not_in")
TEXT = ("contains", "not_contains", "starts_with", "ends_with", "in", "not_in")
OPERATORS = tuple(dict.fromkeys(BASE + NUMERIC + TEXT))


@dataclass(frozen=True)
class Filter:
    column: str
    operator: str
    value: Any = None
    values: Sequence[Any] = field(default_factory=tuple)
    active: bool = True


def operators_for(kind: T.DataType) -> tuple[str, ...]:
    """The operators that a column of this type offers."""
    if isinstance(kind, T.NumericType):
        return BASE + NUMERIC
    return BASE + TEXT if isinstance(kind, T.StringType) else BASE


def coerce_value(text: str, kind: T.DataType) -> Any:
    """A value typed by a user, for a column of this type; empty is null."""
    if text is None or text == "":
        return None
    if isinstance(kind, T.IntegralType):
        return int(text)
    if isinstance(kind, T.NumericType):
        return float(text)
    if isinstance(kind, T.BooleanType):
        return text.strip().lower() == "true"
    return text


def coerce_list(text: str, kind: T.DataType) -> list[Any]:
    return [coerce_value(x.strip(), kind) for x in text.split(",") if x.strip()]


def compile_filter(f: Filter, kind: T.DataType | None = None, null_mode: str = "sql") -> Column:
    """One filter as a Column. ``null_mode='memory'`` keeps rows with null under the negated operators.

    Comparisons with no value, and ``in`` with no list, hold for no row; their negations hold for all.
    """
    c, op, v = F.col(f"`{f.column}`"), f.operator, f.value
    lit = lambda x: F.lit(x).cast(kind) if kind is not None else F.lit(x)
    memory = null_mode == "memory"
    empty = v is None or v == ""
    if op == "equals":
        return c.isNull() if v is None else (c.isNull() | (c == lit(v))) if memory and v == "" else c == lit(v)
    if op == "not_equals":
        return c.isNotNull() if v is None else ~c.eqNullSafe(lit(v)) if memory else c != lit(v)
    if op == "is_null":
        return c.isNull()
    if op == "is_not_null":
        return c.isNotNull()
    if op in ("in", "not_in"):
        if not f.values:
            return F.lit(op == "not_in")
        found = c.isin([lit(x) for x in f.values])
        return found if op == "in" else (F.coalesce(~found, F.lit(True)) if memory else ~found)
    compared = {"greater_than": lambda: c > lit(v), "less_than": lambda: c < lit(v), "greater_equal": lambda: c >= lit(v), "less_equal": lambda: c <= lit(v)}
    compared |= {"contains": lambda: c.contains(str(v)), "starts_with": lambda: c.startswith(str(v)), "ends_with": lambda: c.endswith(str(v))}
    if op in compared:
        return F.lit(False) if empty else compared[op]()
    if op == "not_contains":
        return F.lit(True) if empty else F.coalesce(~c.contains(str(v)), F.lit(True)) if memory else ~c.contains(str(v))
    raise ValueError(f"unknown operator {op!r}")


def compile_filters(filters: Sequence[Filter] | None, schema: T.StructType | None = None, null_mode: str = "sql") -> Column:
    """All active filters, joined by and."""
    kinds = {x.name: x.dataType for x in schema} if schema is not None else {}
    parts = [compile_filter(f, kinds.get(f.column), null_mode) for f in filters or () if f.active]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def apply_filters(df: DataFrame, filters: Sequence[Filter] | None, null_mode: str = "sql") -> DataFrame:
    return df.where(compile_filters(filters, df.schema, null_mode)) if filters else df


class FilterList:
    """An editable list of filters."""

    def __init__(self):
        self.filters: list[Filter] = []

    def add(self, f: Filter) -> None:
        self.filters.append(f)

    def remove(self, i: int) -> None:
        del self.filters[i]

    def update(self, i: int, **changes: Any) -> None:
        from dataclasses import replace

        self.filters[i] = replace(self.filters[i], **changes)

    def toggle(self, i: int) -> None:
        self.update(i, active=not self.filters[i].active)

    def clear(self) -> None:
        self.filters.clear()
