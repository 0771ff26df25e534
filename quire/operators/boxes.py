"""Detections: boxes per page, padding, clamping, region order and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MANIFEST = "map<string,map<string,struct<path:string,boxes:array<array<double>>>>>"
#: fixed values: how sure a detector must be, and pixels added on each side
CONFIDENCE, PAD = 0.25, 5


def clamp(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column, pad: int = PAD) -> list[Column]:
    """Box padded and kept inside the page, whole pixels."""
    whole = lambda c: c.cast("int")
    return [F.greatest(F.lit(0), whole(x1) - pad).alias("x1"), F.greatest(F.lit(0), whole(y1) - pad).alias("y1"), F.least(width, whole(x2) + pad).alias("x2"), F.least(height, whole(y2) + pad).alias("y2")]


def region_names(df: DataFrame, page: list[str], order: list[Column]) -> DataFrame:
    """region_no from the left, regions of the page, suffix: full, left and right, or colN."""
    window = Window.partitionBy(*page)
    out = df.withColumns({"region_no": F.row_number().over(window.orderBy(*order)), "regions": F.count("*").over(window).cast("int")})
    named = F.when(F.col("regions") == 1, "full").when((F.col("regions") == 2) & (F.col("region_no") == 1), "left").when(F.col("regions") == 2, "right").otherwise(F.concat(F.lit("col"), F.col("region_no")))
    return out.withColumn("suffix", named)


def manifest_rows(df: DataFrame, column: str, confidence: float = CONFIDENCE) -> DataFrame:
    """source, page, path, box_no, x1, y1, x2, y2, conf of a JSON manifest of detections that are sure enough."""
    sources = df.select(F.explode(F.from_json(column, MANIFEST)).alias("source", "pages"))
    pages = sources.select("source", F.explode("pages").alias("page", "p"))
    boxes = pages.select("source", "page", "p.path", F.posexplode(F.filter("p.boxes", lambda b: b[4] >= confidence)).alias("box_no", "b"))
    return boxes.select("source", "page", "path", "box_no", *[F.col("b")[i].alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2", "conf"))])
