"""python -m quire JOB ...: the jobs of quire.jobs on folders, for spark-submit or a local session."""

from __future__ import annotations

import argparse
import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.jobs import correction, curation, dataset, evaluation, regions
from quire.sources import readers, sinks


def function(name: str) -> Callable:
    """The function that ``module:name`` names."""
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def configuration(spark: SparkSession, path: str) -> DataFrame:
    """Sources of a JSON file with an object a line: source, source_id, transcript, reading_order."""
    return spark.read.schema(curation.CONFIG).json(path)


def images(spark: SparkSession, path: str) -> DataFrame:
    return readers.files(spark, path, "*.[pP][nN][gG]", recursive=True, content=True)


def detect(spark: SparkSession, args) -> DataFrame:
    found = regions.detect(spark, args.pages, function(args.detector), args.out, args.confidence)
    regions.cut_regions(spark, found, args.pages, f"{args.out}/regions", args.pad)
    return found.groupBy("source").agg(F.count_distinct("page").alias("pages"), F.count("*").alias("regions"))


def lines(spark: SparkSession, args) -> DataFrame:
    return regions.cut_lines(spark, args.pages, args.out).agg(F.count("*").alias("lines"))


def curate(spark: SparkSession, args) -> DataFrame:
    return curation.curate(spark, args.crops, args.transcripts, configuration(spark, args.config), args.out, not args.no_variants, args.by_page, not args.no_status).summary


def rename(spark: SparkSession, args) -> DataFrame:
    return curation.renamed(spark, args.crops, configuration(spark, args.config), args.out)


def prepare(spark: SparkSession, args) -> DataFrame:
    return dataset.prepare(readers.csv(spark, args.rows), images(spark, args.images), args.out, args.copies, args.val_sources, args.seed).groupBy("split").count()


def pairs(spark: SparkSession, args) -> DataFrame:
    return dataset.write_pairs(readers.csv(spark, args.manifest), images(spark, args.images), args.out).agg(F.count("*").alias("files"))


def compile_(spark: SparkSession, args) -> DataFrame:
    sinks.write_compiled(readers.csv(spark, args.manifest), images(spark, args.images), args.out)
    return spark.read.parquet(args.out).agg(F.count("*").alias("rows"))


def evaluate(spark: SparkSession, args) -> DataFrame:
    return evaluation.evaluate(spark, args.manifest, args.images, function(args.recogniser), args.out, args.phase, args.split, args.limit, baseline=args.baseline, batch=args.batch).select("overall.*")


def correct(spark: SparkSession, args) -> DataFrame:
    return correction.report(correction.correct(spark, args.predictions, function(args.corrector), args.out, args.size, args.attempts, args.pace))


#: name: what does it, its required options, its others with their defaults
JOBS = {
    "detect": (detect, ("pages", "detector", "out"), {"confidence": regions.boxes.CONFIDENCE, "pad": regions.boxes.PAD}),
    "lines": (lines, ("pages", "out"), {}),
    "curate": (curate, ("crops", "transcripts", "config", "out"), {"no-variants": False, "by-page": False, "no-status": False}),
    "rename": (rename, ("crops", "config", "out"), {}),
    "dataset": (prepare, ("rows", "images", "out"), {"copies": dataset.COPIES, "val-sources": dataset.VALIDATION_SOURCES, "seed": dataset.SEED}),
    "pairs": (pairs, ("manifest", "images", "out"), {}),
    "compile": (compile_, ("manifest", "images", "out"), {}),
    "evaluate": (evaluate, ("manifest", "images", "recogniser", "out"), {"phase": "evaluation", "split": "val", "limit": 0, "baseline": None, "batch": 4}),
    "correct": (correct, ("predictions", "corrector", "out"), {"size": correction.infer.BATCH, "attempts": correction.infer.ATTEMPTS, "pace": 0.0}),
}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="quire", description="Jobs on folders; paths need a scheme that all executors reach, such as file:// or hdfs://.")
    jobs = out.add_subparsers(dest="job", required=True)
    for name, (_, needed, others) in JOBS.items():
        job = jobs.add_parser(name)
        for option in needed:
            job.add_argument(f"--{option}", required=True)
        for option, default in others.items():
            if default is False:
                job.add_argument(f"--{option}", action="store_true")
            else:
                job.add_argument(f"--{option}", type=str if default is None else type(default), default=default)
    return out


def main(arguments: list[str] | None = None) -> None:
    args = parser().parse_args(arguments)
    JOBS[args.job][0](SparkSession.builder.getOrCreate(), args).show(50, truncate=False)


if __name__ == "__main__":
    main()
