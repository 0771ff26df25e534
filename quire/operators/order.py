"""Positions in an order, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.sources.staging import staged


def numbered(df: DataFrame, groups: list[str], order: list[Column], name: str = "pos", total: str | None = None) -> DataFrame:
    """df with the position, from 1, of each row in its group, and optionally the group's size.

    Rows are range-partitioned by group and order; each range numbers its own, and adds
    how many rows of the group stand in the ranges before: one row for each range and group.
    """
    ranged = df.repartitionByRange(*[F.col(g).asc_nulls_first() for g in groups], *order) if groups or order else df
    held = staged(ranged.withColumn("_range", F.spark_partition_id()))
    sizes = held.groupBy("_range", *groups).agg(F.count("*").alias("_n"))
    by = Window.partitionBy(*groups).orderBy("_range")
    every = F.sum("_n").over(Window.partitionBy(*groups)).alias("_all")
    before = sizes.select("_range", *groups, (F.sum("_n").over(by) - F.col("_n")).alias("_before"), every).withColumnsRenamed({c: f"_b_{c}" for c in ["_range", *groups]})
    own = F.row_number().over(Window.partitionBy("_range", *groups).orderBy(*order))
    match = F.col("_range") == F.col("_b__range")
    for g in groups:
        match = match & F.col(g).eqNullSafe(F.col(f"_b_{g}"))
    out = held.withColumn("_own", own).join(before, match)
    extra = [F.col("_all").alias(total)] if total else []
    return out.select(*df.columns, (F.col("_own") + F.col("_before")).cast("long").alias(name), *extra)


def running(df: DataFrame, groups: list[str], order: list[Column], sums: dict[str, Column], later: dict[str, Column] | None = None) -> DataFrame:
    """df with running sums, up to and with each row of its group, and with the greatest value of each row and those behind it.

    As in ``numbered``, ranges of rows are summed on their own and add what the ranges before (or behind) them give.  The
    order must tell all rows of a group apart.
    """
    later = later or {}
    ranged = df.repartitionByRange(*[F.col(g).asc_nulls_first() for g in groups], *order) if groups or order else df
    held = staged(ranged.withColumn("_range", F.spark_partition_id()))
    totals = held.groupBy("_range", *groups).agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()], *[F.max(c).alias(f"_t_{n}") for n, c in later.items()])
    by = Window.partitionBy(*groups).orderBy("_range")
    before = [F.sum(f"_t_{n}").over(by.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_b_{n}") for n in sums]
    back = Window.partitionBy(*groups).orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    behind = [F.max(f"_t_{n}").over(back).alias(f"_b_{n}") for n in later]
    others = totals.select(F.col("_range").alias("_b__range"), *[F.col(g).alias(f"_b__g_{g}") for g in groups], *before, *behind)
    match = F.col("_range") == F.col("_b__range")
    for g in groups:
        match = match & F.col(g).eqNullSafe(F.col(f"_b__g_{g}"))
    own = Window.partitionBy("_range", *groups)
    up = own.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = held.withColumns({"_i": F.row_number().over(own.orderBy(*order))} | {f"_o_{n}": F.sum(c).over(up) for n, c in sums.items()})
    down = own.orderBy(F.desc("_i")).rowsBetween(Window.unboundedPreceding, 0)  # what follows is costly as a frame, so it is read backwards
    found = found.withColumns({f"_o_{n}": F.max(c).over(down) for n, c in later.items()}) if later else found
    found = found.join(others, match)
    out = [(F.col(f"_o_{n}") + F.coalesce(F.col(f"_b_{n}"), F.lit(0))).alias(n) for n in sums] + [F.greatest(f"_o_{n}", f"_b_{n}").alias(n) for n in later]
    return found.select(*df.columns, *out)
