"""Seeded samples, splits and replication; random order is that of md5 over seed and key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.order import numbered


def draw(seed: int, *key: Column) -> Column:
    """A fixed random rank of a key, the same in any engine that has md5."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in key]))


def sample(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """n rows, without replacement."""
    return df.orderBy(draw(seed, F.col(key)), key).limit(n)


def stratified(df: DataFrame, strata: list[str], key: str, ratio: float = 0.8, seed: int = 42) -> DataFrame:
    """Column split: of each stratum round-half-even(n * ratio) rows are train, at least one, and with two rows or more at least one is val."""
    out = numbered(df.withColumn("_draw", draw(seed, F.col(key))), strata, [F.col("_draw"), F.col(key)], "_pos", "_size")
    train = F.greatest(F.lit(1), F.bround(F.col("_size") * ratio))
    train = F.when(F.col("_size") >= 2, F.least(train, F.col("_size") - 1)).otherwise(train)
    return out.withColumn("split", F.when(F.col("_pos") <= train, "train").otherwise("val")).drop("_draw", "_pos", "_size")


def by_group(df: DataFrame, group: str, n_val: int, seed: int = 42) -> DataFrame:
    """Column split: all rows of n_val drawn groups are val."""
    val = df.select(group).distinct().orderBy(draw(seed, F.coalesce(F.col(group), F.lit(""))), group).limit(n_val).withColumn("_val", F.lit(True)).withColumnRenamed(group, "_group")
    return df.join(F.broadcast(val), F.col(group).eqNullSafe(F.col("_group")), "left").withColumn("split", F.when(F.col("_val"), "val").otherwise("train")).drop("_val", "_group")  # n_val rows


def replicate(df: DataFrame, copies: int) -> DataFrame:
    """Train rows ``copies`` times with aug_id 1.. and is_augmented; val rows once, with aug_id 0."""
    ids = F.when(F.col("split") == "train", F.sequence(F.lit(1), F.lit(copies))).otherwise(F.array(F.lit(0)))
    return df.withColumn("aug_id", F.explode(ids)).withColumn("is_augmented", F.col("aug_id") > 0)
