"""Readers of recognition datasets: files, manifests, transcripts, crops and images."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text

#: fixed values: columns of a manifest, and those that must be there
MANIFEST = "split string, source string, source_id string, page string, line string, image_path string, ground_truth_text string, is_augmented string, aug_id string, orig_image_path string"
REQUIRED = ("split", "source", "source_id", "page", "line", "image_path", "ground_truth_text")
BOM = "﻿"


def fuller(found: DataFrame) -> DataFrame:
    """found, a plain read, in tasks of a full partition's bytes where its files are many and small; Spark counts each as megabytes and would start a task for a few of them."""
    spark = found.sparkSession
    size = int(str(found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    tasks = max(4 * spark.sparkContext.defaultParallelism, -(-size // spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()))
    return found.coalesce(tasks) if found._jdf.queryExecution().toRdd().getNumPartitions() > tasks else found


def files(spark: SparkSession, paths: str | list[str], glob: str = "*", recursive: bool = False, content: bool = False) -> DataFrame:
    """path, name, length of files, and content if asked for; raises if there are none."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).option("ignoreMissingFiles", "true")
    found = reader.load(paths)
    if not found.select("path").take(1):  # one task after the other, until there is a file
        raise FileNotFoundError(f"no {glob} in {paths}")
    return fuller(found).select("path", text.base_name(F.col("path")).alias("name"), "length", *(["content"] if content else []))


#: bytes of files that a task hands on together
TOGETHER = 32 << 20


def contents(paths: DataFrame, path: str = "path") -> DataFrame:
    """path, content of files named in a table, each read by the task that has its row; a file that is not there gives no row.

    Paths have a scheme.  Nothing is listed: a folder's listing is held by the driver, whose memory then grows with the number of files.
    """

    def each(batches):
        from urllib.parse import quote

        from pyarrow import fs

        for pdf in batches:
            out, size = [], 0
            for p in pdf[path]:
                system, bare = fs.FileSystem.from_uri(quote(p, safe=":/@"))
                try:
                    with system.open_input_stream(bare) as f:
                        out.append((p, f.read()))
                except FileNotFoundError:
                    continue
                size += len(out[-1][1])
                if size >= TOGETHER:
                    yield pd.DataFrame(out, columns=["path", "content"])
                    out, size = [], 0
            yield pd.DataFrame(out, columns=["path", "content"])

    return paths.where(F.col(path).isNotNull()).select(path).mapInPandas(each, "path string, content binary")


def numbered_documents(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """Files in the order of their names with source_no from 1; a listing, so small."""
    from quire.operators.order import numbered

    return numbered(files(spark, path, glob), [], [F.col("name")], "source_no")


def pages_of(documents: DataFrame, render) -> DataFrame:
    """source_no, page_no, content of the page images that ``render(bytes)`` yields: one document becomes many rows."""

    def each(batches):
        for pdf in batches:
            for number, data in zip(pdf["source_no"], pdf["content"], strict=True):
                rows = [(number, i + 1, page) for i, page in enumerate(render(bytes(data)))]
                yield pd.DataFrame(rows, columns=["source_no", "page_no", "content"])

    return documents.select("source_no", "content").mapInPandas(each, "source_no long, page_no int, content binary")


def labelled(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Image files (path) for which there is a label file with the same stem."""
    return images.join(labels.select(text.stem(F.col("path")).alias("_stem")).distinct(), text.stem(F.col("path")) == F.col("_stem"), "left_semi")


def whole_texts(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """path, text of UTF-8 files, a row for each."""
    read = spark.read.option("pathGlobFilter", glob).text(path, wholetext=True)
    return fuller(read.select("value", "_metadata.file_path")).select(F.col("file_path").alias("path"), F.replace("value", F.lit(BOM), F.lit("")).alias("text"))


def transcript_lines(texts: DataFrame, keep: list[str]) -> DataFrame:
    """The columns of keep, line_no from 1 over lines that are not blank, and line, stripped."""
    kept = F.filter(F.transform(F.split("text", "\r?\n"), text.strip), lambda x: x != "")
    return texts.select(*keep, F.posexplode(kept).alias("_at", "line")).select(*keep, (F.col("_at") + 1).alias("line_no"), "line")


def docx_lines(data: bytes) -> list[str]:
    """Paragraphs of a word-processor file that are not blank."""
    ns = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as held:
        root = ElementTree.fromstring(held.read("word/document.xml"))
    found = ("".join(t.text or "" for t in p.iter(f"{ns}t")).strip() for p in root.iter(f"{ns}p"))
    return [p for p in found if p]


def docx_texts(documents: DataFrame) -> DataFrame:
    """path, line_no, line of word-processor files."""

    def each(batches):
        for pdf in batches:
            yield pd.DataFrame([(p, i + 1, x) for p, data in zip(pdf["path"], pdf["content"], strict=True) for i, x in enumerate(docx_lines(bytes(data)))], columns=["path", "line_no", "line"])

    return documents.select("path", "content").mapInPandas(each, "path string, line_no int, line string")


def csv(spark: SparkSession, path: str, schema: str | None = None, infer: bool = False) -> DataFrame:
    """CSV with a header, quoted newlines and doubled quotes; names stripped, byte-order marks removed from strings, empty fields ''."""
    reader = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').option("inferSchema", str(infer).lower())
    read = (reader.schema(schema) if schema else reader).csv(path)
    read = read.toDF(*[c.strip().lstrip(BOM) for c in read.columns])
    strings = {c: F.replace(F.coalesce(c, F.lit("")), F.lit(BOM), F.lit("")) for c, kind in read.dtypes if kind == "string"}
    return read.withColumns(strings) if strings else read


def manifest(spark: SparkSession, path: str, split: str | None = None, source: str | None = None, limit: int = 0, order: tuple[str, ...] = ("source_id", "page", "line", "image_path"), required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """Rows of a manifest with an image and a text, of a limit the first in order; raises on missing columns or if nothing is left."""
    rows = csv(spark, path)
    if missing := [c for c in required if c not in rows.columns]:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    if split is not None:
        rows = rows.where(F.lower(F.trim("split")) == split.lower())
    if source is not None:
        rows = rows.where(F.col("source") == source)
    rows = rows.withColumns({c: text.strip(F.col(c)) for c in required}).where(text.present(F.col("image_path")) & text.present(F.col("ground_truth_text")))
    rows = rows.orderBy(*[text.natural_key(F.col(c)) for c in order]).limit(limit) if limit else rows
    if rows.limit(1).count() == 0:
        raise ValueError(f"{path} has no rows to evaluate")
    return rows


def aligned(rows: DataFrame, listing: DataFrame | None = None) -> DataFrame:
    """Rows with status aligned (which is the default) and a text; with a file listing, those whose image exists."""
    status = F.coalesce(F.nullif(F.lower(F.trim("status")), F.lit("")), F.lit("aligned")) if "status" in rows.columns else F.lit("aligned")
    kept = rows.where((status == "aligned") & text.present(F.col("ground_truth_text")) & text.present(F.col("image_path")))
    return kept.join(listing.select(F.col("path").alias("image_path")), "image_path", "left_semi") if listing is not None else kept


def with_content(rows: DataFrame, images: DataFrame) -> DataFrame:
    """rows (image_path) that have a file (path, content), with its content, dealt to as many tasks as a shuffle has partitions.

    So many whatever their bytes: what is done to an image takes longer than to read it, and small partitions would be joined into a few.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = images.select(text.same_path(F.col("path")).alias("_at"), "content").repartition(n, "_at")
    return rows.withColumn("_at", text.same_path(F.col("image_path"))).repartition(n, "_at").join(held.hint("merge"), "_at").drop("_at")


def missing(rows: DataFrame, listing: DataFrame) -> DataFrame:
    """Image paths without a file."""
    return rows.select("image_path").distinct().join(listing.select(F.col("path").alias("image_path")), "image_path", "left_anti")


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", "true").json(path)


#: fixed values: how crops are named
CROP = r"(?i)^(.+)_line_(\d+)(?:\.(\d+))?\.png$"


def crops(listing: DataFrame, variants: bool = True) -> DataFrame:
    """page, line, sub (null: none) parsed from crop names; other names are left out, and variants if not asked for."""
    name = F.col("name")
    out = listing.where(name.rlike(CROP)).select("*", F.regexp_extract(name, CROP, 1).alias("page"), F.regexp_extract(name, CROP, 2).cast("int").alias("line"), text.group_of(name, CROP, 3).cast("int").alias("sub"))
    return out if variants else out.where("sub is null")


def first_existing(spark: SparkSession, paths: list[str]) -> str | None:
    """The first path that its file system has."""
    for p in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return p
    return None


def label_boxes(texts: DataFrame) -> DataFrame:
    """path, box_no, cls, cx, cy, w, h of label files with one box a line."""
    rows = texts.select("path", F.posexplode(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).alias("box_no", "row")).withColumn("v", F.split(F.trim("row"), r"\s+"))
    return rows.select("path", "box_no", F.col("v")[0].cast("int").alias("cls"), *[F.col("v")[i + 1].cast("double").alias(n) for i, n in enumerate(("cx", "cy", "w", "h"))])


def encode_png(grey: np.ndarray) -> bytes:
    """8-bit grey levels as PNG."""
    h, w = grey.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = np.concatenate([np.zeros((h, 1), np.uint8), grey.astype(np.uint8)], axis=1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray, per: int) -> np.ndarray:
    """Bytes of an image row from its filtered ones and the row above; kinds as the format numbers them."""
    if kind == 0:
        return line
    if kind == 1:  # less the pixel to the left: sums along the row
        return line.reshape(-1, per).astype(np.uint64).cumsum(axis=0).astype(np.uint8).ravel()
    if kind == 2:
        return line + above
    given, up, out = line.tolist(), above.tolist(), [0] * len(line)
    for i, x in enumerate(given):
        left, corner = (out[i - per], up[i - per]) if i >= per else (0, 0)
        if kind == 3:
            guess = (left + up[i]) >> 1
        elif kind == 4:
            a, b, c = abs(up[i] - corner), abs(left - corner), abs(left + up[i] - 2 * corner)
            guess = left if a <= b and a <= c else up[i] if b <= c else corner
        else:
            raise ValueError(f"no filter {kind}")
        out[i] = (x + guess) & 255
    return np.array(out, dtype=np.uint8)


def decode_png(data: bytes) -> np.ndarray | None:
    """Grey levels of an 8-bit grey or RGB(A) PNG that isn't interlaced; None for anything else."""
    try:
        if data[:8] != b"\x89PNG\r\n\x1a\n":
            return None
        at, packed, head = 8, b"", None
        while at < len(data):
            size, kind = struct.unpack(">I4s", data[at : at + 8])
            body = data[at + 8 : at + 8 + size]
            head = struct.unpack(">IIBBBBB", body) if kind == b"IHDR" else head
            packed += body if kind == b"IDAT" else b""
            at += 12 + size
        w, h, depth, colour, _, _, interlaced = head
        per = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
        if depth != 8 or per is None or interlaced:
            return None
        raw = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(h, 1 + w * per)
        out, above = np.zeros((h, w, per), dtype=np.uint8), np.zeros(w * per, dtype=np.uint8)
        for y in range(h):
            above = _unfiltered(int(raw[y, 0]), raw[y, 1:], above, per)
            out[y] = above.reshape(w, per)
        if per <= 2:
            return out[:, :, 0].astype(np.uint8)
        return np.rint(out[:, :, :3].astype(float) @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)
    except (struct.error, zlib.error, ValueError, TypeError):
        return None


def grey_images(images: DataFrame) -> DataFrame:
    """path, h, w, px of files that can be decoded; others are left out."""

    def each(batches):
        for pdf in batches:
            found = [(p, decode_png(bytes(c))) for p, c in zip(pdf["path"], pdf["content"], strict=True)]
            yield pd.DataFrame([(p, *g.shape, g.tobytes()) for p, g in found if g is not None], columns=["path", "h", "w", "px"])

    return images.select("path", "content").mapInPandas(each, "path string, h int, w int, px binary")
