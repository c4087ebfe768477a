"""Any analysis by its name: columns and filters are checked, and its results come as named DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from . import information, mining, missing, multivariate, profile, series, stats, text
from .filters import Filter, apply_filters

#: Analyses that take numbers only, and those whose results depend on the order of rows.
NUMERIC = ("basic", "correlation", "changepoint", "factor", "histogram", "timeseries", "canonical")
ORDERED = ("changepoint", "timeseries", "missing")


def text_bundle(df: DataFrame, column: str, k: int = 15, japanese: bool | text.Lexicon = False) -> dict[str, DataFrame]:
    """All that can be said of a text column."""
    return {
        "statistics": text.text_statistics(df, column, japanese),
        "words": text.word_frequency(df, column, k, japanese),
        "characters": text.char_frequency(df, column, k),
        "patterns": text.text_patterns(df, column),
        "languages": text.language_detection(df, column),
        "character_types": text.char_types(df, column),
        "sentences": text.sentence_analysis(df, column, japanese),
        "readability": text.readability_report(df, column, japanese),
    }


def analyse(df: DataFrame, kind: str, columns: Sequence[str], filters: Sequence[Filter] | None = None, order_by: Sequence[str] = (), **options) -> dict[str, DataFrame]:
    """Run the analysis ``kind`` on ``columns`` of the filtered rows: name -> result.

    A ValueError says if there is no such analysis, if it takes another number of columns or other kinds of them, or if
    it needs ``order_by``. Canonical correlation takes the first half of the columns against the others.
    """
    if kind not in profile.ARITY:
        raise ValueError(f"no analysis is called {kind!r}; there are {', '.join(profile.ARITY)}")
    profile.check_arity(kind, columns)
    numbers = {*profile.eligible_columns(df, "numeric"), *profile.eligible_columns(df, "text")}  # text may hold numbers, as in loaded files
    if kind in NUMERIC and (odd := [c for c in columns if c not in numbers]):
        raise ValueError(f"{kind} takes columns of numbers, which {', '.join(odd)} are not")
    if kind in ORDERED and not order_by:
        raise ValueError(f"{kind} depends on the order of rows: give order_by")
    rows, columns, first, order = apply_filters(df, filters), list(columns), columns[0], list(order_by)
    if kind == "column":
        return {"profile": profile.column_profile(rows, columns, order_by=order), "samples": profile.profile_samples(rows, columns, order), "top_values": profile.profile_top_values(rows, columns, order)}
    if kind == "basic":
        return {"statistics": stats.basic_stats(rows, columns)}
    if kind == "correlation":
        return {"pairs": stats.correlation_matrix(rows, columns)}
    if kind == "changepoint":
        return {"points": series.change_points(rows, first, order_by=order, **options)}
    if kind == "factor":
        return {"factors": multivariate.pca(rows, columns, **options)}
    if kind == "histogram":
        return {"bins": stats.histogram(rows, first, **options)}
    if kind == "timeseries":
        return {"series": series.time_series(rows, first, order_by=order, **options)}
    if kind == "missing":
        flags = missing.missing_flags(rows, columns, order, **options)
        return {"events": missing.missing_events(flags), "columns": missing.missing_stats(flags), "summary": missing.missing_summary(flags)}
    if kind == "text":
        return text_bundle(rows, first, **options)
    if kind == "association":
        itemsets = mining.frequent_itemsets(rows, columns, **options)
        return {"itemsets": itemsets, "rules": mining.association_rules(itemsets)}
    if kind == "mutual":
        pairs = information.mutual_information(rows, columns, **options)
        return {"pairs": pairs, "summary": information.mutual_information_summary(pairs)}
    half = (len(columns) + 1) // 2
    result = multivariate.canonical_correlation(rows, columns[:half], columns[half:], **options)
    return {"correlations": result, "loadings": multivariate.canonical_loadings(result)}
