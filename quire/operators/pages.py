"""Page images as tables: files in, line images, regions or recognised texts out."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators import boxes, image
from quire.sources import readers

LINES = "path string, page string, line int, name string, height int, width int, png binary"


def line_images(files: DataFrame) -> DataFrame:
    """A row for each text line of each page file: its number from the top, a name for it and its image as PNG.

    files: path, content.  Files that cannot be decoded, and pages without lines, give no row.
    """

    def each(batches):
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                grey = readers.decode_png(bytes(content)) if content is not None else None
                page = str(path).rsplit("/", 1)[-1].rsplit(".", 1)[0]
                for k, found in enumerate(image.page_lines(grey) if grey is not None else [], 1):
                    out.append((path, page, k, f"{page}_line_{k:03d}.png", *found.shape, readers.encode_png(found)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in LINES.split(", ")])

    return files.select("path", "content").mapInPandas(each, LINES)


REGIONS = "path string, page string, region_no int, name string, x1 int, y1 int, x2 int, y2 int, png binary"


def region_images(files: DataFrame, detected: DataFrame, pad: int = boxes.PAD) -> DataFrame:
    """A row for each detected box of a page file, left to right: named by its place, padded, kept inside the page, cut out as PNG.

    files: path, content; detected: path, box_no, x1, y1, x2, y2.  Boxes without a pixel are left out.
    """
    held = detected.select("path", F.struct("x1", "box_no", "y1", "x2", "y2").alias("b")).groupBy("path").agg(F.sort_array(F.collect_list("b")).alias("found"))

    def each(batches):
        for pdf in batches:
            out = []
            for path, content, found in zip(pdf["path"], pdf["content"], pdf["found"], strict=True):
                grey = readers.decode_png(bytes(content)) if content is not None else None
                if grey is None:
                    continue
                page, n = str(path).rsplit("/", 1)[-1].rsplit(".", 1)[0], len(found)
                for k, b in enumerate(found, 1):
                    x1, y1, x2, y2 = max(0, int(b["x1"]) - pad), max(0, int(b["y1"]) - pad), min(grey.shape[1], int(b["x2"]) + pad), min(grey.shape[0], int(b["y2"]) + pad)
                    name = "full" if n == 1 else ("left", "right")[k - 1] if n == 2 else f"col{k}"
                    if x2 > x1 and y2 > y1:
                        out.append((path, page, k, f"{page}_{name}.png", x1, y1, x2, y2, readers.encode_png(grey[y1:y2, x1:x2])))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in REGIONS.split(", ")])

    return files.select("path", "content").join(held, "path").mapInPandas(each, REGIONS)


def detections(files: DataFrame, detector: Callable[[np.ndarray], list[tuple[float, float, float, float, float]]], confidence: float = boxes.CONFIDENCE) -> DataFrame:
    """path, box_no, x1, y1, x2, y2, conf of what ``detector(grey levels)`` finds and is sure enough of."""
    schema = "path string, box_no int, x1 double, y1 double, x2 double, y2 double, conf double"

    def each(batches):
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                grey = readers.decode_png(bytes(content)) if content is not None else None
                found = [b for b in detector(grey) if b[4] >= confidence] if grey is not None else []
                out += [(path, k, *map(float, b)) for k, b in enumerate(found)]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return files.select("path", "content").mapInPandas(each, schema)


def recognised(lines: DataFrame, recogniser: Callable[[list[np.ndarray]], list[str]], batch: int = 4, column: str = "prediction") -> DataFrame:
    """lines (with a column png) and what ``recogniser`` reads in batches of so many images; white space is collapsed, an image that cannot be decoded reads ''."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in lines.schema)}, `{column}` string"

    def each(batches):
        for pdf in batches:
            greys = [readers.decode_png(bytes(c)) if c is not None else None for c in pdf["png"]]
            known, texts = [k for k, g in enumerate(greys) if g is not None], [""] * len(greys)
            for lo in range(0, len(known), batch):
                part = known[lo : lo + batch]
                for k, said in zip(part, recogniser([greys[k] for k in part]), strict=True):
                    texts[k] = " ".join((said or "").split())
            yield pdf.assign(**{column: texts})

    return lines.mapInPandas(each, schema)
