"""Quality counters, comparisons of two runs, histograms and training curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counters(df: DataFrame, text: str, exists: Column) -> DataFrame:
    """Rows, null and blank texts, rows that repeat an earlier text (nulls are alike), rows without a file."""
    distinct = df.select(text).distinct().agg(F.count("*").alias("_texts"))
    row = df.agg(F.count("*").alias("rows"), F.count_if(F.col(text).isNull()).alias("null_texts"), F.count_if(F.trim(text) == "").alias("blank_texts"), F.count_if(~exists).alias("missing"))
    return row.crossJoin(distinct).select("rows", "null_texts", "blank_texts", (F.col("rows") - F.col("_texts")).alias("duplicate_texts"), "missing")  # one row each


def changes(df: DataFrame, before: str, after: str) -> DataFrame:
    """How many rows became better, stayed, became worse, and their shares in percent."""
    n = df.agg(F.count("*").alias("n"), F.count_if(F.col(after) < F.col(before)).alias("improved"), F.count_if(F.col(after) == F.col(before)).alias("same"), F.count_if(F.col(after) > F.col(before)).alias("worse"))
    return n.select("*", *[(100.0 * F.col(c) / F.col("n")).alias(f"{c}_pct") for c in ("improved", "same", "worse")])


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Count by bin, from 1, of values clipped to the range; the last bin holds its upper end."""
    clipped = F.least(F.greatest(F.col(value), F.lit(low)), F.lit(high))
    bin_ = F.least(F.floor((clipped - low) / ((high - low) / bins)) + 1, F.lit(bins)).cast("int")
    return df.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"))


def early_stop(df: DataFrame, run: str, order: list[str], value: str, patience: int) -> DataFrame:
    """Of each run (smaller is better): step and value of the best, and the step where patience ends, or null.

    A run is one training's epochs, so it is small.
    """
    window = Window.partitionBy(run).orderBy(*order)
    steps = df.select(run, value, F.row_number().over(window).alias("step"), F.min(value).over(window.rowsBetween(Window.unboundedPreceding, -1)).alias("_best"))
    better = steps.withColumn("_gain", F.when(F.col("_best").isNull() | (F.col(value) < F.col("_best")), F.col("step")))
    since = better.withColumn("_last", F.max("_gain").over(Window.partitionBy(run).orderBy("step")))
    stop = F.min(F.when(F.col("step") - F.col("_last") >= patience, F.col("step"))).over(Window.partitionBy(run))
    live = since.withColumn("stop_step", stop).where(F.col("stop_step").isNull() | (F.col("step") <= F.col("stop_step")))
    return live.groupBy(run).agg(F.min_by("step", F.struct(value, "step")).alias("best_step"), F.min(value).alias("best_value"), F.first("stop_step").alias("stop_step"))
