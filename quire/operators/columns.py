"""Small column operators: selection by name, renaming, defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def containing(df: DataFrame, *parts: str) -> list[str]:
    """Names of columns that contain one of the parts, in order: the loss and metric columns of a training history."""
    return [c for c in df.columns if any(p in c for p in parts)]


def without(df: DataFrame, *names: str) -> DataFrame:
    """df less the named columns it has."""
    return df.drop(*names)


def with_constants(df: DataFrame, **values) -> DataFrame:
    """df with constant columns, such as a split's name."""
    return df.withColumns({k: F.lit(v) for k, v in values.items()})


def filled(df: DataFrame, **defaults) -> DataFrame:
    """Nulls of the named columns replaced; a column that is missing is its default."""
    return df.withColumns({k: F.coalesce(F.col(k), F.lit(v)) if k in df.columns else F.lit(v) for k, v in defaults.items()})


def complete(df: DataFrame, *names: str) -> DataFrame:
    """Rows without a null in the named columns."""
    return df.dropna(subset=list(names))


def log_mentions(log: Column, *marks: str) -> Column:
    """Does a captured log hold one of the marks, such as an out-of-memory message?"""
    found = [F.contains(log, F.lit(m)) for m in marks]
    out = found[0]
    for f in found[1:]:
        out = out | f
    return F.coalesce(out, F.lit(False))


def ladder(sizes: list[int], attempt):
    """The result of the first size, in order, at which ``attempt(size)`` returns something but None: batch sizes after memory errors."""
    for size in sizes:
        if (out := attempt(size)) is not None:
            return size, out
    return None
