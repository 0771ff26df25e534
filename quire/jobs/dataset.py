"""From aligned rows to a training set: split by source, varied copies of training images, manifests and sidecar texts."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import text
from quire.operators import image, split
from quire.sources import readers, sinks
from quire.sources.staging import staged

COPIES, VALIDATION_SOURCES, SEED = 5, 2, 42
ROW = "source string, source_id string, page string, line string, image_path string, ground_truth_text string"


def random_of(seed: int, path: str, copy: int) -> np.random.Generator:
    """The numbers of one copy of one image, the same in any task."""
    return np.random.default_rng([seed, zlib.crc32(path.encode()), copy])


def write_images(rows: DataFrame, images: DataFrame, out: str, copies: int = COPIES, seed: int = SEED, vary: Callable = image.augment, opener: Callable = sinks.open_shared) -> DataFrame:
    """The manifest of the images written below out: validation ones as they are, training ones ``copies`` times, each varied.

    rows: split and ROW; images: path, content.  A file is <split>/images/<source>/<stem>.png, or <stem>__aug_NN.png.  Rows without a file
    give nothing, nor do training images that cannot be decoded.  A task that runs again writes the same files.
    """
    held = rows.select("split", *[F.col(c.split()[0]).cast("string") for c in ROW.split(", ")]).withColumns({"slug": text.slug(F.col("source")), "stem": text.stem(F.col("image_path"))})
    met = readers.with_content(held, images)
    fields = [f.split()[0] for f in readers.MANIFEST.split(", ")]

    def each(batches):
        for pdf in batches:
            done = []
            for r in pdf.itertuples(index=False):
                folder = f"{out.rstrip('/')}/{r.split}/images/{r.slug}"
                if r.split == "train":
                    grey = readers.decode_png(bytes(r.content)) if r.content is not None else None
                    made = [(k, f"{folder}/{r.stem}__aug_{k:02d}.png", readers.encode_png(vary(grey, random_of(seed, r.image_path, k)))) for k in range(1, copies + 1)] if grey is not None else []
                else:
                    made = [(0, f"{folder}/{r.stem}.png", bytes(r.content))]
                for k, path, data in made:
                    with opener(path) as f:
                        f.write(data)
                    done.append((r.split, r.source, r.source_id, r.page, r.line, path, r.ground_truth_text, "1" if k else "0", str(k), r.image_path))
            yield pd.DataFrame(done, columns=fields)

    return staged(met.mapInPandas(each, readers.MANIFEST), "manifest")


def prepare(rows: DataFrame, images: DataFrame, out: str, copies: int = COPIES, sources: int = VALIDATION_SOURCES, seed: int = SEED, vary: Callable = image.augment) -> DataFrame:
    """Splits rows by source_id, writes their images and the manifests (out/manifests, a folder for each split); the manifest.

    Only aligned rows with a text are taken.  At least one row must be left.
    """
    kept = readers.aligned(rows)
    if not kept.take(1):
        raise ValueError("no aligned rows")
    manifest = write_images(split.by_group(kept, "source_id", sources, seed), images, out, copies, seed, vary)
    sinks.write_manifests(manifest, f"{out}/manifests")
    return manifest


def write_pairs(manifest: DataFrame, images: DataFrame, out: str) -> DataFrame:
    """Writes <split>/<stem>.png and <stem>.gt.txt for each aligned row with a file, and a list of the paths without one (out/missing); paths written."""
    status = F.coalesce(F.col("status"), F.lit("aligned")) == "aligned" if "status" in manifest.columns else F.lit(True)
    rows = sinks.sidecar_names(manifest.where(status))
    sinks.write_lines(readers.missing(rows.withColumn("image_path", text.same_path(F.col("image_path"))), images.select(text.same_path(F.col("path")).alias("path"))), "image_path", f"{out}/missing")
    met = readers.with_content(rows, images)
    said = F.encode(F.replace(F.coalesce("ground_truth_text", F.lit("")), F.lit(readers.BOM), F.lit("")), "UTF-8")
    both = F.array(F.struct(F.lit(".png").alias("end"), F.col("content").alias("data")), F.struct(F.lit(".gt.txt").alias("end"), said.alias("data")))
    named = met.select("split", "stem", F.explode(both).alias("x")).select(F.concat("split", F.lit("/"), "stem", "x.end").alias("name"), F.col("x.data").alias("data"))
    return staged(sinks.write_files(named, "name", "data", out), "pairs")
