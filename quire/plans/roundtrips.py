"""Readers, writers and column rules: what is written to the shared folder and read again."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quire.functions import text
from quire.operators import columns, pages
from quire.operators.order import numbered
from quire.plans.lines import table
from quire.sources import readers, sinks
from quire.sources.staging import scratch

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


@query("csv_roundtrip", "SELECT doc_id, CAST(length(coalesce(text, '')) AS INTEGER) AS chars, md5(coalesce(text, '')) AS digest, coalesce(source, '') AS source FROM documents")
def csv_roundtrip(spark, sf_dir):
    """Texts with quotes and newlines as CSV and back."""
    path = scratch(spark, "csv")
    sinks.write_csv(table(spark, sf_dir, "documents"), path, ["doc_id", "text", "source"])
    return readers.csv(spark, path).select(F.col("doc_id").cast("long").alias("doc_id"), F.length("text").alias("chars"), F.md5("text").alias("digest"), "source")


@query("csv_inferred", "SELECT p_partkey, p_name, p_size, p_retailprice FROM part")
def csv_inferred(spark, sf_dir):
    """Types inferred again from CSV."""
    path = scratch(spark, "csv")
    sinks.write_csv(table(spark, sf_dir, "part"), path, ["p_partkey", "p_name", "p_size", "p_retailprice"])
    return readers.csv(spark, path, infer=True).withColumn("p_partkey", F.col("p_partkey").cast("long"))


@query("source_folders", "SELECT trim(regexp_replace(lower(n_name) || ' / ' || n_regionkey, '[^A-Za-z0-9]+', '_', 'g'), '_') AS folder, lower(n_name) || ' / ' || n_regionkey AS source_id, n_nationkey FROM nation")
def source_folders(spark, sf_dir):
    """A folder of CSV for each source, named so that any file system takes it."""
    path = scratch(spark, "by-source")
    named = table(spark, sf_dir, "nation").select(F.concat(F.lower("n_name"), F.lit(" / "), F.col("n_regionkey").cast("string")).alias("source_id"), "n_nationkey")
    sinks.write_by_source(named, path)
    return readers.csv(spark, path).select("folder", "source_id", F.col("n_nationkey").cast("int").alias("n_nationkey"))


MANIFEST = "m AS (SELECT CASE WHEN doc_id % 3 = 0 THEN 'Val ' ELSE 'train' END AS split, coalesce(source, '') AS source, 's' || (doc_id % 4) AS source_id, lang AS page, CAST(doc_id AS VARCHAR) AS line, 'img/' || doc_id || '.png' AS image_path, CASE WHEN doc_id % 5 = 0 THEN ' ' || chr(160) ELSE string_split(text, chr(10))[1] END AS t FROM documents)"


def _manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    said = F.when(F.col("doc_id") % 5 == 0, "  ").otherwise(F.split("text", "\n")[0])
    name = F.concat(F.lit("img/"), F.col("doc_id").cast("string"), F.lit(".png"))
    rows = docs.select(F.when(F.col("doc_id") % 3 == 0, "Val ").otherwise("train").alias("split"), "source", F.concat(F.lit("s"), (F.col("doc_id") % 4).cast("string")).alias("source_id"), F.col("lang").alias("page"), F.col("doc_id").cast("string").alias("line"), name.alias("image_path"), said.alias("ground_truth_text"))
    return columns.with_constants(rows, is_augmented="0", aug_id="0")


@query("manifest_rows_read", f"WITH {MANIFEST} SELECT source_id, line, image_path, regexp_replace(t, '^\\s+|\\s+$', '', 'g') AS ground_truth_text FROM m WHERE lower(trim(split)) = 'val' AND regexp_replace(t, '^[\\s\\xA0]+|[\\s\\xA0]+$', '', 'g') <> ''")
def manifest_rows_read(spark, sf_dir):
    """Rows of a split, trimmed and case-folded, that have an image and a text."""
    path = scratch(spark, "manifest")
    sinks.write_csv(_manifest(spark, sf_dir), path)
    return readers.manifest(spark, path, "val").select("source_id", "line", "image_path", "ground_truth_text")


@query("manifest_limit", f"WITH {MANIFEST} SELECT source_id, line FROM m WHERE source = 'src1' AND regexp_replace(t, '^[\\s\\xA0]+|[\\s\\xA0]+$', '', 'g') <> '' ORDER BY source_id, page, CAST(line AS BIGINT) LIMIT 7")
def manifest_limit(spark, sf_dir):
    """The first rows, in natural order, of one source."""
    path = scratch(spark, "manifest")
    sinks.write_csv(_manifest(spark, sf_dir), path)
    return readers.manifest(spark, path, source="src1", limit=7).select("source_id", "line")


@query("split_folders", f"WITH {MANIFEST} SELECT trim(split) AS split, count(*) AS n FROM m GROUP BY 1 UNION ALL SELECT 'full', count(*) FROM m")
def split_folders(spark, sf_dir):
    """A manifest a split, and the full one above them."""
    path = scratch(spark, "splits")
    sinks.write_manifests(_manifest(spark, sf_dir).withColumn("split", F.trim("split")), path)
    held = readers.csv(spark, path)
    return held.groupBy("split").agg(F.count("*").alias("n")).unionByName(held.agg(F.lit("full").alias("split"), F.count("*").alias("n")))


STATUS = "CASE doc_id % 4 WHEN 0 THEN ' Aligned' WHEN 1 THEN '' WHEN 2 THEN 'unaligned_excess_image' END"


@query("aligned_rows", f"WITH s AS (SELECT doc_id, {STATUS} AS status, CASE WHEN doc_id % 7 = 0 THEN '  ' ELSE text END AS t FROM documents) SELECT doc_id FROM s WHERE coalesce(nullif(lower(trim(status)), ''), 'aligned') = 'aligned' AND trim(t) <> '' AND doc_id IN (SELECT doc_id FROM labels)")
def aligned_rows(spark, sf_dir):
    """Rows whose status is aligned, which is the default, with a text and an existing file."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    status = F.when(F.col("doc_id") % 4 == 0, " Aligned").when(F.col("doc_id") % 4 == 1, "").when(F.col("doc_id") % 4 == 2, "unaligned_excess_image")
    rows = docs.select("doc_id", status.alias("status"), F.when(F.col("doc_id") % 7 == 0, "  ").otherwise(F.col("text")).alias("ground_truth_text"), F.col("doc_id").cast("string").alias("image_path"))
    return readers.aligned(rows, labels.select(F.col("doc_id").cast("string").alias("path")).distinct()).select("doc_id")


@query("missing_files", "SELECT DISTINCT 'img/' || doc_id AS value FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_files(spark, sf_dir):
    """The log of image paths without a file, a line for each."""
    rows = table(spark, sf_dir, "documents").select(F.concat(F.lit("img/"), F.col("doc_id").cast("string")).alias("image_path"))
    listing = table(spark, sf_dir, "labels").select(F.concat(F.lit("img/"), F.col("doc_id").cast("string")).alias("path"))
    path = scratch(spark, "missing")
    sinks.write_lines(readers.missing(rows, listing), "image_path", path)
    return spark.read.text(path)


@query("json_payload", "SELECT c_mktsegment AS segment, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY c_mktsegment")
def json_payload(spark, sf_dir):
    """A nested document of results by group, indented, and back."""
    by = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))
    payload = by.agg(F.map_from_entries(F.collect_list(F.struct("c_mktsegment", F.struct("n", "total")))).alias("per_source"))  # a few groups
    path = scratch(spark, "json")
    sinks.write_json(payload, path)
    return readers.json_document(spark, path, "per_source map<string,struct<n:bigint,total:double>>").select(F.explode("per_source").alias("segment", "m")).select("segment", "m.n", "m.total")


@query("transcript_files", "SELECT lower(n_name) AS stem, CAST(unnest([1, 2]) AS INTEGER) AS line_no, unnest([n_name || ' é', n_nationkey || ' x']) AS line FROM nation")
def transcript_files(spark, sf_dir):
    """A text file for each source, with a mark, blank lines and white space, read again as lines."""
    nation = table(spark, sf_dir, "nation")
    said = F.concat(F.lit("﻿ \t"), F.col("n_name"), F.lit(" é \r\n\n  \n"), F.col("n_nationkey").cast("string"), F.lit(" x"))
    path = scratch(spark, "transcripts")
    written = sinks.write_files(nation.select(F.concat(F.lower("n_name"), F.lit(".txt")).alias("name"), said.alias("t")), "name", "t", path)
    written.write.format("noop").mode("overwrite").save()
    return readers.transcript_lines(readers.whole_texts(spark, path).select(F.regexp_replace(text.stem(F.col("path")), "%20", " ").alias("stem"), "text"), ["stem"])


LEVELS = "g AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(least(greatest(floor((x::DOUBLE + 1) * 128), 0), 255) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL)"


def _images(spark, sf_dir):
    """vec_id, content: 8 x 8 grey images as PNG."""

    def drawn(batches):
        for pdf in batches:
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "content": [readers.encode_png(np.clip(np.floor((np.asarray(v, dtype=float) + 1) * 128), 0, 255).astype(np.uint8).reshape(8, 8)) for v in pdf["embedding"]]})

    return table(spark, sf_dir, "embeddings").where("embedding is not null").select("vec_id", "embedding").mapInPandas(drawn, "vec_id long, content binary")


@query("image_files", f"WITH {LEVELS} SELECT vec_id, 8 AS h, 8 AS w, CAST(list_sum(v) AS BIGINT) AS total FROM g")
def image_files(spark, sf_dir):
    """PNG files written, listed, read and decoded."""
    path = scratch(spark, "images")
    named = _images(spark, sf_dir).withColumn("name", F.concat(F.lit("v"), F.col("vec_id").cast("string"), F.lit(".png")))
    sinks.write_files(named, "name", "content", path).write.format("noop").mode("overwrite").save()
    listed = readers.files(spark, path, "*.png", content=True)

    def summed(batches):
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "h": pdf["h"], "w": pdf["w"], "total": [int(np.frombuffer(x, np.uint8).sum()) for x in pdf["px"]]})

    found = readers.grey_images(listed).mapInPandas(summed, "path string, h int, w int, total long")
    return found.select(F.regexp_extract("path", r"v(\d+)\.png$", 1).cast("long").alias("vec_id"), "h", "w", "total")


@query("compiled_rows", f"WITH {LEVELS} SELECT 'v' || vec_id AS image_path, 't' || vec_id AS ground_truth_text FROM g WHERE vec_id % 2 = 0")
def compiled_rows(spark, sf_dir):
    """Images and texts as one table, without rows that lack a file."""
    files = _images(spark, sf_dir).where("vec_id % 2 = 0").select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("path"), "content")
    rows = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("image_path"), F.concat(F.lit("t"), F.col("vec_id").cast("string")).alias("ground_truth_text"))
    path = scratch(spark, "compiled")
    sinks.write_compiled(rows, files, path)
    return spark.read.parquet(path).select("image_path", "ground_truth_text")


@query("crop_names", "SELECT l_orderkey, l_linenumber, CAST(l_partkey AS VARCHAR) || CASE l_returnflag WHEN 'A' THEN 'left' ELSE '' END AS page, CAST(l_suppkey AS INTEGER) AS line, CASE WHEN l_linestatus = 'F' THEN l_linenumber END AS sub FROM lineitem WHERE l_returnflag <> 'R'")
def crop_names(spark, sf_dir):
    """Page, line and variant parsed from names of crops; other names are left out."""
    end = F.when(F.col("l_returnflag") == "R", ".jpg").otherwise(".png")
    name = F.concat(F.col("l_partkey").cast("string"), F.when(F.col("l_returnflag") == "A", "left").otherwise(""), F.format_string("_line_%03d", "l_suppkey"), F.when(F.col("l_linestatus") == "F", F.concat(F.lit("."), F.col("l_linenumber").cast("string"))).otherwise(""), end)
    return readers.crops(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", name.alias("name"))).select("l_orderkey", "l_linenumber", "page", "line", "sub")


@query("canonical_crops", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linestatus <> 'F'")
def canonical_crops(spark, sf_dir):
    """Crops that are no variants."""
    name = F.concat(F.lit("p_line_"), F.col("l_suppkey").cast("string"), F.when(F.col("l_linestatus") == "F", ".2").otherwise(""), F.lit(".png"))
    return readers.crops(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", name.alias("name")), variants=False).select("l_orderkey", "l_linenumber")


@query("label_boxes", "SELECT 'o' || l_orderkey AS path, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_discount, l_tax, l_quantity) - 1 AS INTEGER) AS box_no, l_linenumber AS cls, l_discount AS cx, l_tax AS cy, l_quantity AS w, l_quantity AS h FROM lineitem")
def label_boxes(spark, sf_dir):
    """Boxes of label files, a line for each."""
    line = F.concat_ws(" ", *[F.col(c).cast("string") for c in ("l_linenumber", "l_discount", "l_tax", "l_quantity", "l_quantity")])
    rows = table(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("path")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_discount", "l_tax", "l_quantity", line.alias("t")))).alias("b"))
    return readers.label_boxes(rows.select("path", F.concat(F.array_join("b.t", "\n\n"), F.lit("\n")).alias("text"))).select("path", "box_no", "cls", "cx", "cy", "w", "h")


@query("labelled_images", "SELECT 'img/' || doc_id || '.png' AS path FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def labelled_images(spark, sf_dir):
    """Images with a label file of the same stem."""
    images = table(spark, sf_dir, "documents").select(F.concat(F.lit("img/"), F.col("doc_id").cast("string"), F.lit(".png")).alias("path"))
    labels = table(spark, sf_dir, "labels").select(F.concat(F.lit("lbl/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"))
    return readers.labelled(images, labels)


@query("sidecar_stems", "SELECT l_orderkey, l_linenumber, 's' || l_suppkey || '_p' || l_partkey || printf('_l%03d', l_linenumber) || CASE WHEN l_linenumber % 3 > 0 THEN printf('_aug%02d', l_linenumber % 3) ELSE '' END AS stem FROM lineitem")
def sidecar_stems(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("source_id"), F.col("l_partkey").cast("string").alias("page"), F.col("l_linenumber").alias("line"), (F.col("l_linenumber") % 3).alias("aug_id"))
    return sinks.sidecar_names(rows).select("l_orderkey", "l_linenumber", "stem")


@query("source_numbers", "SELECT n_name, row_number() OVER (ORDER BY n_name) AS source_no FROM nation")
def source_numbers(spark, sf_dir):
    """Sources numbered in the order of their names."""
    return numbered(table(spark, sf_dir, "nation").select("n_name"), [], [F.col("n_name")], "source_no")


@query("column_rules", "SELECT o_orderkey, o_totalprice, 'val' AS split, CASE WHEN o_orderkey % 4 = 0 THEN 'none' ELSE o_orderpriority END AS o_orderpriority, 0 AS aug_id FROM orders WHERE o_orderkey % 5 <> 0")
def column_rules(spark, sf_dir):
    """Constants, defaults of nulls and of missing columns, rows without nulls, columns dropped and picked by parts of their names."""
    rows = table(spark, sf_dir, "orders").withColumns({"o_orderpriority": F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority")), "o_totalprice": F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice"))})
    rows = columns.complete(columns.without(rows, "o_orderdate", "status"), "o_totalprice")
    out = columns.filled(columns.with_constants(rows, split="val"), o_orderpriority="none", aug_id=0)
    return out.select("o_orderkey", "split", "aug_id", *columns.containing(out, "price", "priority"))


@query("log_mentions", "SELECT event_type, count(*) AS n, count(*) FILTER (WHERE contains(props, '1') OR contains(props, 'out of memory')) AS mentioned FROM events GROUP BY event_type")
def log_mentions(spark, sf_dir):
    found = table(spark, sf_dir, "events").select("event_type", columns.log_mentions(F.col("props"), "1", "out of memory").alias("m"))
    return found.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if("m").alias("mentioned"))


@query("two_places", "SELECT n_nationkey, n_name, unnest(['first', 'second']) AS place FROM nation")
def two_places(spark, sf_dir):
    """The same rows written to two places."""
    paths = {p: scratch(spark, p) for p in ("first", "second")}
    sinks.write_everywhere(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), list(paths.values()))
    first, second = (columns.with_constants(readers.csv(spark, path), place=p) for p, path in paths.items())
    return first.unionByName(second).select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name", "place")


@query("backup_rows", "SELECT 'now' AS version, r_regionkey + 10 AS r_regionkey FROM region UNION ALL SELECT 'before', r_regionkey FROM region")
def backup_rows(spark, sf_dir):
    """A table kept under the time before it is overwritten."""
    path, rows = f"{scratch(spark, 'kept')}/rows", table(spark, sf_dir, "region").select("r_regionkey")
    sinks.write_csv(rows, path)
    kept = sinks.backup(spark, path)
    sinks.write_csv(rows.withColumn("r_regionkey", F.col("r_regionkey") + 10), path)
    now, before = (columns.with_constants(readers.csv(spark, at), version=v) for v, at in (("now", path), ("before", kept)))
    return now.unionByName(before).select("version", F.col("r_regionkey").cast("int").alias("r_regionkey"))


@query("first_folder", "SELECT n_name FROM nation")
def first_folder(spark, sf_dir):
    """The first of several places that exists."""
    path = scratch(spark, "there")
    table(spark, sf_dir, "nation").select("n_name").write.parquet(path)
    return spark.read.parquet(readers.first_existing(spark, [f"{path}-not", path, f"{path}-nor"]))


@query("recognised_images", f"WITH {LEVELS} SELECT vec_id, CAST(list_sum(v) AS BIGINT) || ' of ' || list_max(v) AS prediction FROM g")
def recognised_images(spark, sf_dir):
    """A stand-in recogniser called with batches of images; white space is collapsed."""
    held = _images(spark, sf_dir).withColumnRenamed("content", "png")
    return pages.recognised(held, lambda greys: [f" {int(g.sum())}  of\n{g.max()} " for g in greys]).select("vec_id", "prediction")


@query("detected_regions", f"WITH {LEVELS}, b AS (SELECT vec_id, unnest([0, 1]) AS box_no, v, unnest([v[1] / 64.0, v[2] / 32.0]) AS x1, unnest([5.5, 6.0]) AS x2, unnest([v[3], v[4]]) / 255.0 AS conf FROM g), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x1, box_no) AS no, count(*) OVER (PARTITION BY vec_id) AS n FROM b WHERE conf >= 0.25) SELECT 'v' || vec_id || '_' || CASE WHEN n = 1 THEN 'full' WHEN no = 1 THEN 'left' ELSE 'right' END || '.png' AS name, CAST(greatest(0, trunc(x1) - 1) AS INTEGER) AS x1, CAST(least(8, trunc(x2) + 1) AS INTEGER) AS x2 FROM k WHERE greatest(0, trunc(x1) - 1) < least(8, trunc(x2) + 1)")
def detected_regions(spark, sf_dir):
    """A stand-in detector's boxes, sure enough, padded, kept inside the page and cut out from the left."""
    files = _images(spark, sf_dir).select(F.concat(F.lit("pages/v"), F.col("vec_id").cast("string"), F.lit(".png")).alias("path"), "content")
    found = pages.detections(files, lambda g: [(g[0, 0] / 64.0, 0.0, 5.5, 8.0, g[0, 2] / 255.0), (g[0, 1] / 32.0, 1.0, 6.0, 7.0, g[0, 3] / 255.0)])
    return pages.region_images(files, found, 1).select("name", "x1", "x2")
