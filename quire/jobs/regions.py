"""From page images to regions and lines: a detector's manifest, regions cut out, lines cut out of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text
from quire.operators import boxes, pages
from quire.sources import readers, sinks
from quire.sources.staging import staged


def source_of(path: Column) -> Column:
    """The folder that a file is in."""
    return text.base_name(text.parent(path))


def manifest(files: DataFrame, found: DataFrame) -> DataFrame:
    """value: a JSON document for each source, {source: {page: {path, boxes}}}, with every page, also those on which nothing was found.

    files: path; found: path, box_no, x1, y1, x2, y2, conf.  A document holds the pages of one source.
    """
    box = F.struct("box_no", F.array("x1", "y1", "x2", "y2", "conf").alias("b"))
    held = found.groupBy(F.col("path").alias("_p")).agg(F.sort_array(F.collect_list(box)).alias("x"))
    every = files.select("path").join(held, F.col("path") == F.col("_p"), "left")
    page = F.struct("path", F.coalesce("x.b", F.array().cast("array<array<double>>")).alias("boxes"))
    of_source = every.groupBy(source_of(F.col("path")).alias("source")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(text.stem(F.col("path")).alias("page"), page.alias("v"))))).alias("pages"))
    return of_source.select(F.to_json(F.create_map("source", "pages")).alias("value"))


def read_manifest(spark: SparkSession, path: str, confidence: float = boxes.CONFIDENCE) -> DataFrame:
    """What ``boxes.manifest_rows`` gives of the manifests in a folder."""
    return boxes.manifest_rows(spark.read.text(path), "value", confidence)


def detect(spark: SparkSession, folder: str, detector: Callable, out: str, confidence: float = boxes.CONFIDENCE) -> DataFrame:
    """Writes the manifest of all pages below folder to out/manifest; its rows, read again."""
    files = readers.files(spark, folder, "*.[pP][nN][gG]", recursive=True, content=True)
    found = staged(pages.detections(files, detector, confidence), "boxes")
    manifest(files, found).write.mode("overwrite").text(f"{out}/manifest")
    return read_manifest(spark, f"{out}/manifest", confidence)


def _written(images: DataFrame, out: str) -> DataFrame:
    named = images.withColumn("name", F.concat_ws("/", source_of(F.col("path")), "name"))
    return staged(sinks.write_files(named, "name", "png", out), "files")


def cut_regions(spark: SparkSession, found: DataFrame, folder: str, out: str, pad: int = boxes.PAD) -> DataFrame:
    """Writes the regions of a manifest's rows, named by their place on the page, to a folder for each source below out; paths written."""
    files = readers.files(spark, folder, "*.[pP][nN][gG]", recursive=True, content=True)
    return _written(pages.region_images(files, found.select("path", "box_no", "x1", "y1", "x2", "y2"), pad), out)


def cut_lines(spark: SparkSession, folder: str, out: str) -> DataFrame:
    """Writes the lines of all images below folder, numbered from the top, to a folder for each source below out; paths written."""
    return _written(pages.line_images(readers.files(spark, folder, "*.[pP][nN][gG]", recursive=True, content=True)), out)
