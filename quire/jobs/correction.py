"""From predictions and a corrector to corrected lines with metrics before and after, and reports on what changed."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import edits, text
from quire.operators import infer, metrics
from quire.sources import readers, sinks
from quire.sources.staging import staged

BINS, HIGH = 40, 0.5
METRICS = ("cer", "wer", "chrf")
#: values alike to so many decimals are the same
DIGITS = 9


def corrected(predicted: DataFrame, call: Callable[[list[str]], list[str]], size: int = infer.BATCH, attempts: int = infer.ATTEMPTS, pace: float = 0.0, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """image_path, ground_truth_text, prediction, correction of rows with both texts: neighbouring lines in batches, in the order of image_path."""
    rows = predicted.select("image_path", "ground_truth_text", "prediction").dropna(subset=["ground_truth_text", "prediction"])
    batches = infer.batched(rows, [F.col("image_path"), F.col("ground_truth_text"), F.col("prediction")], size)
    found = infer.corrected(batches, "prediction", call, attempts, pace, sleep)
    return found.select("image_path", "ground_truth_text", "prediction", F.col("corrected").alias("correction"))


def counted(lines: DataFrame) -> DataFrame:
    """lines with what all metrics stem from: _cn and _wn, characters and words of the reference, and _ce, _we and _g, edits and n-gram matches, before and after."""
    ref = F.coalesce("ground_truth_text", F.lit(""))
    out = lines.withColumns({"_cn": F.length(ref), "_wn": F.size(text.words(ref))})
    for when, hyp in (("before", F.coalesce("prediction", F.lit(""))), ("after", F.coalesce("correction", F.lit("")))):
        out = out.withColumns({f"_ce_{when}": edits.char_edits(ref, hyp), f"_we_{when}": edits.word_edits(ref, hyp), f"_g_{when}": edits.gram_counts(ref, hyp, spaces=False)})
    return out


def with_metrics(rows: DataFrame) -> DataFrame:
    """The lines with cer, wer and chrf of each, before and after; rates are 0 where the reference is blank; rows: ``counted``."""
    out, blank = rows, ~text.present(F.col("ground_truth_text"))
    for when in ("before", "after"):
        rate = lambda e, n: F.when(blank, 0.0).otherwise(metrics.safe_ratio(F.col(f"{e}_{when}"), F.col(n)))  # noqa: B023, E731
        sums = {f"_g{i}": F.col(f"_g_{when}")[i] for i in range(3 * edits.ORDERS)}
        out = out.withColumns({f"cer_{when}": rate("_ce", "_cn"), f"wer_{when}": rate("_we", "_wn")} | sums).withColumn(f"chrf_{when}", metrics.chrf_effective(beta=3.0, scale=1.0)).drop(*sums)
    return out.select("image_path", "ground_truth_text", "prediction", "correction", *[f"{m}_{w}" for m in METRICS for w in ("before", "after")])


def overall(rows: DataFrame) -> DataFrame:
    """stage, cer, wer, chrf of all lines before and after: sums of edits over sums of lengths as they are; rows: ``counted``."""
    stages = F.array(*[F.struct(F.lit(w).alias("stage"), F.col(f"_ce_{w}").alias("ce"), F.col(f"_we_{w}").alias("we"), F.col("_cn").alias("cn"), F.col("_wn").alias("wn"), F.col(f"_g_{w}").alias("grams")) for w in ("before", "after")])
    sums = rows.select(F.explode(stages).alias("x")).select("x.*").groupBy("stage").agg(*[F.sum(c).alias(c) for c in ("ce", "cn", "we", "wn")], *metrics.gram_sums())
    return sums.select("stage", metrics.safe_ratio(F.col("ce"), F.col("cn")).alias("cer"), metrics.safe_ratio(F.col("we"), F.col("wn")).alias("wer"), metrics.chrf_effective().alias("chrf"))


def report(lines: DataFrame) -> DataFrame:
    """metric, n, improved, same, worse, median and mean before and after, and the relative gain of the means, for each metric; lines: ``with_metrics``.

    A rate improves where it falls, chrF where it rises.
    """
    sums, rows = [F.count("*").alias("n")], []
    for m in METRICS:
        before, after = (F.round(f"{m}_{w}", DIGITS) for w in ("before", "after"))
        better, worse = (after > before, after < before) if m == "chrf" else (after < before, after > before)
        sums += [F.count_if(c).alias(f"{m}_{n}") for c, n in ((better, "improved"), (after == before, "same"), (worse, "worse"))]
        sums += [f(f"{m}_{w}").alias(f"{m}_{n}_{w}") for n, f in (("median", F.median), ("mean", F.avg)) for w in ("before", "after")]
        names = ("improved", "same", "worse", "median_before", "median_after", "mean_before", "mean_after")
        gain = F.try_divide(F.col(f"{m}_mean_before") - F.col(f"{m}_mean_after"), F.col(f"{m}_mean_before")) * (-1 if m == "chrf" else 1)
        rows.append(F.struct(F.lit(m).alias("metric"), "n", *[F.col(f"{m}_{n}").alias(n) for n in names], gain.alias("relative_gain")))
    return lines.agg(*sums).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def histograms(lines: DataFrame, high: float = HIGH, bins: int = BINS) -> DataFrame:
    """metric, stage, bin, n of the error rates, clipped to 0 and ``high``."""
    each = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(w).alias("stage"), F.col(f"{m}_{w}").alias("x")) for m in ("cer", "wer") for w in ("before", "after")])
    rows = lines.select(F.explode(each).alias("r")).select("r.*")
    bin_ = F.least(F.floor(F.least(F.greatest("x", F.lit(0.0)), F.lit(high)) / (high / bins)) + 1, F.lit(bins)).cast("int")
    return rows.groupBy("metric", "stage", bin_.alias("bin")).agg(F.count("*").alias("n"))


def correct(spark: SparkSession, predicted: str, call: Callable[[list[str]], list[str]], out: str, size: int = infer.BATCH, attempts: int = infer.ATTEMPTS, pace: float = 0.0) -> DataFrame:
    """Predictions (CSV) to corrected lines with metrics (out/lines, CSV), overall and report (JSON lines); the lines read again."""
    found = corrected(readers.csv(spark, predicted), call, size, attempts, pace)
    rows = staged(counted(found.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))), "corrected")  # the work is that of Python, not of bytes
    lines = with_metrics(rows)
    sinks.write_csv(lines, f"{out}/lines")
    sinks.write_json(overall(rows), f"{out}/overall", pretty=False)
    sinks.write_json(report(lines), f"{out}/report", pretty=False)
    return lines
