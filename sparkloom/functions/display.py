"""Numbers and sizes as text for people, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
UNITS = ("Bytes", "KB", "MB", "GB", "TB", "PB", "EB", "ZB", "YB")
UNKNOWN_NUMBER, UNKNOWN_SIZE = "N/A", "サイズ不明"


def fixed_text(c: Column, digits: int = 1) -> Column:
    """A number with that many decimals."""
    return F.format_string(f"%.{digits}f", c.cast("double"))


def _bare(text: Column) -> Column:
    """Without trailing zeros after the point."""
    return F.regexp_replace(text, r"\.?0+$", "")


def _exponent(c: Column, digits: int) -> Column:
    return F.regexp_replace(F.format_string(f"%.{digits}e", c), r"e([+-])0(\d)$", "e$1$2")


def number_label(c: Column) -> Column:
    """A number as a table cell: exponents from a billion up and below a thousandth, thousands grouped, few decimals.

    Null and not-a-number are ``N/A``; whole numbers have no decimals, others no trailing zeros. Halves round up.
    """
    x = c.cast("double")
    size = F.abs(x)
    return (
        F.when(x.isNull() | F.isnan(x), UNKNOWN_NUMBER)
        .when(size >= 1e9, _exponent(x, 2))
        .when((size > 0) & (size < 0.001), _exponent(x, 3))
        .when(x == F.floor(x), F.format_number(x, 0))
        .when(size >= 1000, _bare(F.format_number(x, 2)))
        .when(size >= 0.01, _bare(fixed_text(x, 4)))
        .otherwise(_bare(fixed_text(x, 6)))
    )


def bytes_label(c: Column, decimals: int = 2) -> Column:
    """A size in the largest unit of 1024s that leaves it at 1 or more; null, negative and not-a-number are unknown."""
    x = c.cast("double")
    steps = F.array(*(F.lit(1024.0**k) for k in range(len(UNITS))))
    step = F.array_max(F.filter(steps, lambda s: (s <= x) | (s == 1)))
    unit = F.element_at(F.array(*map(F.lit, UNITS)), F.array_position(steps, step).cast("int"))
    value = fixed_text(F.round(x / step, max(0, decimals)), max(0, decimals))
    text = F.when(F.contains(value, F.lit(".")), _bare(value)).otherwise(value)
    return F.when(x.isNull() | F.isnan(x) | (x < 0), UNKNOWN_SIZE).otherwise(F.concat(text, F.lit(" "), unit))


def memory_label(c: Column) -> Column:
    """A size in MB, or in GB from one up, with two decimals."""
    x = c.cast("double")
    return F.when(x >= 2**30, F.concat(fixed_text(x / 2**30, 2), F.lit(" GB"))).when(x.isNotNull(), F.concat(fixed_text(x / 2**20, 2), F.lit(" MB")))
