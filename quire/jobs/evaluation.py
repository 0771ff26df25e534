"""From a manifest and a recogniser to predictions and a document of metrics, compared with a baseline's."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import edits
from quire.operators import metrics, pages
from quire.sources import readers, sinks
from quire.sources.staging import staged

#: fixed values: columns of predictions, and of a record of metrics
FIELDS = ["source", "source_id", "page", "line", "image_path", "ground_truth_text", "prediction"]
RECORD = "struct<num_samples:bigint,CER:double,WER:double,chrF:double,cer_edits:bigint,cer_chars:bigint,wer_edits:bigint,wer_words:bigint>"
DOCUMENT = f"phase string, overall {RECORD}, per_source map<string,{RECORD}>"
COMPARED = ("CER", "WER", "chrF")


def predictions(rows: DataFrame, images: DataFrame, recogniser: Callable[[list[np.ndarray]], list[str]], batch: int = 4) -> DataFrame:
    """FIELDS: what the recogniser reads from each row's file; rows without a file give nothing."""
    met = readers.with_content(rows.select(*FIELDS[:-1]), images).withColumnRenamed("content", "png")
    return pages.recognised(met, recogniser, batch).select(*FIELDS)


def records(predicted: DataFrame, key: str = "source_id", ref: str = "ground_truth_text", hyp: str = "prediction") -> DataFrame:
    """key (null: all rows), m: the record of metrics of each group and of all rows, in one pass over them."""
    said = predicted.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.coalesce(ref, F.lit("")).alias("ref"), F.coalesce(hyp, F.lit("")).alias("hyp"))
    counted = metrics.with_edits(said).withColumn("grams", edits.gram_counts(F.col("ref"), F.col("hyp")))
    sums = counted.rollup("key").agg(F.grouping("key").alias("all"), *metrics.edit_sums(), *metrics.gram_sums())
    m = F.struct("num_samples", metrics.safe_ratio(F.col("cer_edits"), F.col("cer_chars")).alias("CER"), metrics.safe_ratio(F.col("wer_edits"), F.col("wer_words")).alias("WER"), metrics.chrf().alias("chrF"), "cer_edits", "cer_chars", "wer_edits", "wer_words")
    return sums.select(F.when(F.col("all") == 0, F.col("key")).alias("key"), "all", m.alias("m"))


def document(predicted: DataFrame, phase: str, settings: dict[str, Column] | None = None, baseline: DataFrame | None = None) -> DataFrame:
    """One row: phase, the settings, overall, per_source (sources are few), and with a baseline what changed against it.

    baseline: a document with overall, or no row, which makes the differences null.  A difference is positive where the
    rate fell or chrF rose.
    """
    found = records(predicted)
    held = found.agg(F.max(F.when(F.col("all") == 1, F.col("m"))).alias("overall"), F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("all") == 0, F.struct("key", "m"))))).alias("per_source"))
    own = [F.lit(phase).alias("phase"), *[v.alias(k) for k, v in (settings or {}).items()], "overall", "per_source"]
    if baseline is None:
        return held.select(*own)
    before = baseline.agg(F.first("overall").alias("before"))  # one row, also where there is none
    one = lambda c: F.struct(*[F.col(f"{c}.{x}").alias(x) for x in COMPARED])
    delta = F.struct(*[((F.col("overall.chrF") - F.col("before.chrF")) if x == "chrF" else F.col(f"before.{x}") - F.col(f"overall.{x}")).alias(f"{x}_delta") for x in COMPARED])
    return held.crossJoin(before).select(*own, F.struct(one("before").alias("baseline"), one("overall").alias("current"), delta.alias("improvement")).alias("comparison"))  # one row each


def written(predicted: DataFrame, out: str, phase: str, settings: dict[str, Column] | None = None, baseline: str | None = None) -> DataFrame:
    """Writes predictions (CSV) and metrics (JSON) below out; the document read again.  baseline: the metrics of an earlier run, if they exist."""
    spark, rows = predicted.sparkSession, staged(predicted.select(*FIELDS), "predictions")
    sinks.write_csv(rows, f"{out}/predictions")
    earlier = None
    if baseline is not None:
        there = readers.first_existing(spark, [baseline])
        earlier = readers.json_document(spark, baseline, DOCUMENT) if there else spark.createDataFrame([], DOCUMENT)
    places = F.struct(F.lit(f"{out}/predictions").alias("predictions"), F.lit(f"{out}/metrics").alias("metrics"))
    made = document(rows, phase, {**(settings or {}), "outputs": places}, earlier)
    sinks.write_json(made, f"{out}/metrics")
    return spark.read.schema(made.schema).option("multiLine", "true").json(f"{out}/metrics")


def compared(stages: DataFrame, order: str = "place") -> DataFrame:
    """stages with <name>_delta, what changed against the stage before, and <name>_gain, the share of the first stage's rate that is gone.

    stages: place and COMPARED, a row for each run of a line of models, so a few.  Null for the first stage; chrF gains by its rise.
    """
    ahead = Window.orderBy(order)
    first = lambda c: F.first(c).over(ahead.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    later = F.row_number().over(ahead) > 1
    delta = {f"{c}_delta": F.col(c) - F.lag(c).over(ahead) for c in COMPARED}
    gain = {f"{c}_gain": F.when(later, F.try_divide(F.col(c) - first(c), first(c)) * (1 if c == "chrF" else -1)) for c in COMPARED}
    return stages.withColumns(delta | gain)


def stages_of(spark: SparkSession, metrics_of: list[tuple[str, str]]) -> DataFrame:
    """place, stage, num_samples and COMPARED of the documents that ``written`` left, in order: (stage, path)."""
    out = None
    for k, (stage, path) in enumerate(metrics_of):
        row = readers.json_document(spark, path, DOCUMENT).select(F.lit(k).alias("place"), F.lit(stage).alias("stage"), "overall.num_samples", *[f"overall.{c}" for c in COMPARED])
        out = row if out is None else out.unionByName(row)
    return out


def evaluate(spark: SparkSession, manifest: str, images: str, recogniser: Callable, out: str, phase: str, split: str | None = "val", limit: int = 0, settings: dict[str, Column] | None = None, baseline: str | None = None, batch: int = 4) -> DataFrame:
    """Reads a split of a manifest and the folder of its images, lets the recogniser read them, and writes predictions and metrics."""
    rows = readers.manifest(spark, manifest, split, limit=limit)
    files = readers.files(spark, images, "*.[pP][nN][gG]", recursive=True, content=True)
    return written(predictions(rows, files, recogniser, batch), out, phase, settings, baseline)
