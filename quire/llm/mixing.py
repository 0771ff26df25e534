"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source's target is its share, by weight, of a total; no target exceeds
``most`` times the source's size, and what is above is shared anew by weight.
A target's complete epochs take every document; what remains is sampled without
replacement: documents stand in the order of -ln(u) / weight, u fixed by seed and doc_id, and
are taken while their sizes' running sum is below the rest; the one that
crosses it gives its first words only.

Keys fall into ranges, whose sums place each document: only
the range where a source crosses its budget is sorted, so a source with most rows is no
task of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.storage import written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
RANGES = 4096
SEED = 17
#: document weights by quality label; null: not labelled
QUALITY = {1: 2.0, 0: 0.5, None: 1.0}
WHITE = r" \t\n\x0B\f\r"


def word_count(text: Column) -> Column:
    """Number of runs of characters other than 0x20 and 0x09-0x0D; a null has none."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(F.length(inner) == 0, F.lit(0)).otherwise(F.size(F.split(inner, f"[{WHITE}]+"))).cast("long")


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word; used where a document is taken in part."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"[{WHITE}]*[^{WHITE}]+"), F.lit(0)), F.lit(1), F.greatest(n, F.lit(0)).cast("int")), "")


def quality_weights(labels: DataFrame) -> DataFrame:
    """doc_id, weight from the highest quality label of each doc_id."""
    best = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return best.select("doc_id", F.when(F.col("quality") >= 1, QUALITY[1]).otherwise(QUALITY[0]).alias("weight"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target of a table with one row (source, source_size) for each source.

    Windows go over that whole table, in one task: a row for each source is all it holds.
    """
    every, ordered = Window.partitionBy(), Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(ordered) - 1) % len(weights)
    weighed = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))).withColumn("total", share * F.sum("source_size").over(every))
    full = most * F.col("source_size")
    by = Window.orderBy(full / F.col("w"), F.col("source").asc_nulls_last())
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum(full).over(before), F.lit(0.0))) / F.sum("w").over(after)
    leveled = weighed.withColumn("level", level).withColumn("level", F.min(F.when(F.col("level") * F.col("w") <= full, F.struct((full / F.col("w")).alias("at"), F.col("level").alias("level")))).over(every)["level"])
    return leveled.select("source", "source_size", F.least(full.cast("double"), F.coalesce(F.col("w") * F.col("level"), F.lit(0.0))).alias("target"))


def mix(docs: DataFrame, quality: DataFrame | None = None, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED, ranges: int = RANGES, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every document, and the columns of ``keep``, which must have other names.

    quality: doc_id (unique), weight (positive; 1 where a document has none).
    A null text has size 0 and gives nothing.  Null sources are one source, the last.  Repeated rows
    are documents of their own that share a key; their order does not change any sum.
    Runs over the same rows agree.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"), *keep)
    if quality is not None:
        narrow = narrow.join(quality.select(F.col("doc_id").alias("_id"), "weight"), F.col("doc_id") == F.col("_id"), "left").drop("_id")
    else:
        narrow = narrow.withColumn("weight", F.lit(1.0))
    u = (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"))), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    weight = F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(QUALITY[None])), F.lit(1e-9))
    narrow = narrow.withColumn("key", -F.ln(u) / weight).drop("weight")
    narrow = written(narrow.withColumn("range", F.floor((1 - F.exp(-F.col("key"))) * ranges).cast("int")), "mixing")
    sums = narrow.groupBy("source", "range").agg(F.sum("size").alias("words"))
    sized = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    budget = F.floor(F.col("target") + 0.5)
    planned = sized.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)).withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
    running = sums.withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy("range"))).withColumnRenamed("source", "_source")
    crossing = (
        planned.join(running, F.col("source").eqNullSafe(F.col("_source")))
        .where((F.col("upto") - F.col("words") < F.col("rest")) & (F.col("upto") >= F.col("rest")))
        .groupBy("source")
        .agg(F.min("range").alias("crossing"), F.min(F.col("upto") - F.col("words")).alias("before"))
        .withColumnRenamed("source", "_source")
    )
    plan = planned.join(crossing, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source").withColumnRenamed("source", "_source")
    plan = written(plan, "mixing-plan")  # a row for each source
    placed = narrow.join(plan, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    whole = placed.where(F.col("crossing").isNull() | (F.col("range") != F.col("crossing")))
    whole = whole.withColumn("part", F.when(F.col("range") < F.col("crossing"), F.col("size")).otherwise(0))
    ranked = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    cut = placed.where(F.col("range") == F.col("crossing"))
    cut = cut.withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before") - F.coalesce(F.sum("size").over(ranked), F.lit(0)))))
    return whole.unionByName(cut).select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).cast("long").alias("taken"), *keep)
