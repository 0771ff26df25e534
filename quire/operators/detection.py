"""Quality of a detector: boxes found against true ones, precision and recall, average precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.metrics import safe_ratio
from quire.operators.order import running
from quire.sources.staging import staged

#: fixed values: overlaps at which a box counts as found
OVERLAPS = tuple(round(0.5 + 0.05 * k, 2) for k in range(10))


def overlap(a: str, b: str) -> Column:
    """Intersection over union of the boxes in struct columns a and b; 0 where both have no area."""
    side = lambda c, k: F.greatest(F.lit(0.0), F.col(f"{c}.{k}2") - F.col(f"{c}.{k}1"))
    both = [F.greatest(F.lit(0.0), F.least(F.col(f"{a}.{k}2"), F.col(f"{b}.{k}2")) - F.greatest(F.col(f"{a}.{k}1"), F.col(f"{b}.{k}1"))) for k in "xy"]
    inner = both[0] * both[1]
    return safe_ratio(inner, side(a, "x") * side(a, "y") + side(b, "x") * side(b, "y") - inner)


def corners(cx: Column, cy: Column, w: Column, h: Column, width: Column, height: Column) -> list[Column]:
    """x1, y1, x2, y2 in pixels of a label file's box, which is given by its centre and size as shares of the page."""
    return [((cx - w / 2) * width).alias("x1"), ((cy - h / 2) * height).alias("y1"), ((cx + w / 2) * width).alias("x2"), ((cy + h / 2) * height).alias("y2")]


def _box() -> Column:
    return F.struct(*[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")])


def matched(truth: DataFrame, found: DataFrame, least: float = OVERLAPS[0]) -> DataFrame:
    """path, cls, box_no, conf, above, upto of every box found: it is right at overlaps greater than above, up to upto; both null: never.

    truth: path, cls, box_no, x1, y1, x2, y2; found: these and conf.  A box found stands for the true box of its page and class that it
    overlaps most (of equal ones the first), if by ``least``.  Of several that stand for one and reach an overlap, the surest is right there
    (of equal ones the first).  Boxes of one page meet each other, which are few.
    """
    key = ["path", "cls"]
    real = truth.select(*key, F.col("box_no").alias("true_no"), _box().alias("t"))
    given = found.select(*key, "box_no", F.col("conf").cast("double").alias("conf"), _box().alias("f"))
    pairs = given.join(real, key).withColumn("iou", overlap("t", "f")).where(F.col("iou") >= least)
    best = pairs.groupBy(*key, "box_no", "conf").agg(F.max(F.struct("iou", (-F.col("true_no")).alias("n"))).alias("b"))
    surer = Window.partitionBy(*key, "true_no").orderBy(F.desc("conf"), "box_no").rowsBetween(Window.unboundedPreceding, -1)
    hits = best.select(*key, "box_no", F.col("b.iou").alias("upto"), (-F.col("b.n")).alias("true_no"), "conf").withColumn("above", F.coalesce(F.max("upto").over(surer), F.lit(0.0)))
    return given.drop("f").join(hits.drop("true_no", "conf"), [*key, "box_no"], "left").select(*key, "box_no", "conf", "above", "upto")


def curves(truth: DataFrame, found: DataFrame, overlaps: tuple[float, ...] = OVERLAPS) -> DataFrame:
    """cls, level, path, box_no, conf, right, precision, recall, envelope of each box found, from the surest down, at each overlap.

    envelope is the greatest precision at this recall or beyond.  A class is spread over tasks, however many boxes it has.
    """
    known = truth.groupBy("cls").agg(F.count("*").alias("n_truth"))
    order, levels = [F.col("conf").desc(), F.col("path"), F.col("box_no")], range(len(overlaps))
    right = [F.coalesce((F.col("above") < x) & (F.col("upto") >= x), F.lit(False)).cast("long") for x in overlaps]
    counted = {"_n": F.lit(1)} | {f"_r{i}": c for i, c in enumerate(right)}  # a column for each overlap, as all have one order
    placed = running(matched(truth, found, min(overlaps)), ["cls"], order, counted)
    held = running(placed, ["cls"], order, {}, {f"_e{i}": F.col(f"_r{i}") / F.col("_n") for i in levels}).join(F.broadcast(known), "cls", "left")  # a row for each class
    row = lambda i: F.struct(F.lit(overlaps[i]).alias("level"), right[i].alias("right"), (F.col(f"_r{i}") / F.col("_n")).alias("precision"), safe_ratio(F.col(f"_r{i}"), F.col("n_truth")).alias("recall"), F.col(f"_e{i}").alias("envelope"))
    return held.select("cls", "path", "box_no", "conf", F.explode(F.array(*[row(i) for i in levels])).alias("x")).select("cls", "x.level", "path", "box_no", "conf", "x.right", "x.precision", "x.recall", "x.envelope")


def by_class(truth: DataFrame, found: DataFrame, overlaps: tuple[float, ...] = OVERLAPS) -> DataFrame:
    """cls, level, n_truth, n_found, right, ap, precision, recall, conf of each class with a true box, at each overlap.

    ap is the area under the envelope.  precision, recall and conf are those where their F1 is greatest (of equal ones the surest).
    A class of which nothing is found has ap 0.
    """
    every = truth.groupBy("cls").agg(F.count("*").alias("n_truth")).withColumn("level", F.explode(F.array(*[F.lit(x) for x in overlaps])))
    f1 = safe_ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    top = F.max(F.struct(f1.alias("f1"), "conf", "precision", "recall")).alias("top")
    sums = curves(truth, found, overlaps).groupBy("cls", "level").agg(F.count("*").alias("n_found"), F.sum("right").alias("right"), F.sum(F.when(F.col("right") == 1, F.col("envelope"))).alias("area"), top)
    zero = lambda c, kind: F.coalesce(c, F.lit(0)).cast(kind)
    out = every.join(sums, ["cls", "level"], "left")
    return out.select("cls", "level", "n_truth", zero(F.col("n_found"), "long").alias("n_found"), zero(F.col("right"), "long").alias("right"), zero(F.col("area") / F.col("n_truth"), "double").alias("ap"), zero(F.col("top.precision"), "double").alias("precision"), zero(F.col("top.recall"), "double").alias("recall"), F.col("top.conf").alias("conf"))


def summary(classes: DataFrame, loose: float = OVERLAPS[0]) -> DataFrame:
    """map50, map50_95, precision, recall: means over classes, at the loosest overlap but for map50_95, which is over all; what ``by_class`` returns."""
    first = F.col("level") == loose
    mean = lambda c: F.avg(F.when(first, F.col(c)))
    return classes.agg(mean("ap").alias("map50"), F.avg("ap").alias("map50_95"), mean("precision").alias("precision"), mean("recall").alias("recall"))


def evaluated(truth: DataFrame, found: DataFrame, overlaps: tuple[float, ...] = OVERLAPS) -> tuple[DataFrame, DataFrame]:
    """``by_class``, written once, and its ``summary``."""
    classes = staged(by_class(truth, found, overlaps), "classes")
    return classes, summary(classes, min(overlaps))
