"""Positional alignment of two ordered sequences, and lookups that stand for joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text
from quire.operators.order import numbered

ALIGNED, EXCESS_LEFT, EXCESS_RIGHT = "aligned", "excess_left", "excess_right"


def align(left: DataFrame, right: DataFrame, keys: list[str], order_left: list[Column], order_right: list[Column]) -> DataFrame:
    """Full outer alignment: the i-th row of each key on the left with the i-th on the right, pos and status."""
    a = numbered(left, keys, order_left).withColumn("_a", F.lit(1))
    b = numbered(right, keys, order_right).withColumn("_b", F.lit(1)).withColumnsRenamed({k: f"_r_{k}" for k in [*keys, "pos"]})
    same = F.col("pos") == F.col("_r_pos")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    status = F.when(F.col("_b").isNull(), EXCESS_LEFT).when(F.col("_a").isNull(), EXCESS_RIGHT).otherwise(ALIGNED)
    picked = [F.when(F.col("_a").isNull(), F.col(f"_r_{k}")).otherwise(F.col(k)).alias(k) for k in [*keys, "pos"]]
    rest = [c for c in a.columns + b.columns if c not in {*keys, "pos", "_a", "_b"} and not c.startswith("_r_")]
    return a.join(b, same, "full").select(*picked, *rest, status.alias("status"))


def unresolved(aligned: DataFrame) -> DataFrame:
    """What has no partner, from either side."""
    return aligned.where(F.col("status") != ALIGNED)


def summary(aligned: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of each side, aligned rows and the difference, by key."""
    left, right = F.count_if(F.col("status") != EXCESS_RIGHT), F.count_if(F.col("status") != EXCESS_LEFT)
    return aligned.groupBy(*keys).agg(left.alias("left_rows"), right.alias("right_rows"), F.count_if(F.col("status") == ALIGNED).alias("aligned_rows"), (left - right).alias("diff"))


def rank_in(value: Column, order: list[str], otherwise: int = 10_000) -> Column:
    """Place of a value in a reading order, from 0; ``otherwise`` where it is not in it."""
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.coalesce(value, F.lit("")))
    return F.when(place > 0, place - 1).otherwise(otherwise).cast("int")


def page_order(page: Column, rank: Column) -> list[Column]:
    """Sort keys of pages: place in the reading order, number, side."""
    return [rank, text.page_number(page), text.side_rank(page)]


def overlap(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct rows of left whose keys right has as well."""
    return left.distinct().join(right.select(*keys).distinct(), keys, "left_semi")
