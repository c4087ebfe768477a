"""Reading typed values out of text columns, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_EDGES = r"(?U)^[\s\x{FEFF}]+|[\s\x{FEFF}]+$"


def as_column(c: Column | str) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c


def trim_text(c: Column | str) -> Column:
    """White space of any kind, with the byte order mark, off both ends."""
    return F.regexp_replace(as_column(c), _EDGES, "")


def has_text(c: Column | str) -> Column:
    """Whether anything is left after trimming; null for null. Looks no further than the first such character."""
    return as_column(c).rlike(r"(?U)[^\s\x{FEFF}]")


def is_numeric_type(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def num(df: DataFrame, name: str) -> Column:
    """The column as a finite double, or null. Text counts if it is a plain decimal number, with or without exponent."""
    kind, c = df.schema[name].dataType, as_column(name)
    if isinstance(kind, T.StringType):
        text = trim_text(c)
        value = F.when(text.rlike(NUMBER), text.try_cast("double"))
    elif is_numeric_type(kind):
        value = c.cast("double")
    else:
        value = F.lit(None).cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


#: Date forms in the order in which they are tried, each with a pattern that it must match.
DATE_FORMS = (
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}", "yyyy-MM-dd'T'HH:mm:ss", 19),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}", "yyyy-MM-dd HH:mm:ss", 19),
    (r"^\d{4}-\d{2}-\d{2}", "yyyy-MM-dd", 10),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy", 10),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d", 10),
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d", 10),
    (r"^\d{4}年\d{1,2}月\d{1,2}日 \d{1,2}時\d{1,2}分\d{1,2}秒$", "yyyy年M月d日 H時m分s秒", 40),
    (r"^\d{4}年\d{1,2}月\d{1,2}日$", "yyyy年M月d日", 40),
)


def parse_date(c: Column | str) -> Column:
    """Text as a timestamp in any of DATE_FORMS, or null."""
    text = trim_text(c)
    return F.coalesce(*(F.when(text.rlike(p), F.try_to_timestamp(F.substring(text, 1, n), F.lit(form))) for p, form, n in DATE_FORMS))


def is_date(c: Column | str) -> Column:
    """Whether text starts like a date, with months and days of two digits."""
    return F.coalesce(trim_text(as_column(c).cast("string")).rlike(r"^\d{4}-\d{2}-\d{2}|^\d{2}/\d{2}/\d{4}|^\d{4}/\d{2}/\d{2}"), F.lit(False))


def epoch_ms(c: Column | str) -> Column:
    return F.unix_millis(parse_date(c))


def size_band(c: Column) -> Column:
    """A number's band: negative, zero, low to 10, medium to 100, high to 1000, very high."""
    return F.when(c < 0, "negative").when(c == 0, "zero").when(c <= 10, "low").when(c <= 100, "medium").when(c <= 1000, "high").when(c.isNotNull(), "very_high")


def equal_width_bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Bin number from 0; the maximum falls in the last bin, and a constant in bin 0."""
    return F.when(high == low, 0).otherwise(F.least(F.floor((value - low) / ((high - low) / bins)), F.lit(bins - 1))).cast("int")


def safe_percent(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole) * 100, F.lit(0.0))


def steady(c: Column) -> Column:
    """Six decimals by a floor off any natural tie, so that float noise in the last digit doesn't show."""
    return F.floor(c * 1e6 + 0.37) / 1e6
