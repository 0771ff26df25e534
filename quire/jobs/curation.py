"""From line crops and transcripts to an aligned table: ordered, numbered, paired, checked, written."""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import text
from quire.operators import align
from quire.sources import readers, sinks
from quire.sources.staging import staged

#: fixed values: columns of the aligned table, and how its rows are marked
FIELDS = ["source", "source_id", "page", "line", "image_path", "ground_truth_text", "status"]
STATUS = {align.ALIGNED: "aligned", align.EXCESS_LEFT: "unaligned_excess_image", align.EXCESS_RIGHT: "unaligned_excess_transcript"}
NO_PAGE = "N/A"
CONFIG = "source string, source_id string, transcript string, reading_order array<string>"


@dataclasses.dataclass(frozen=True)
class Curated:
    """rows has FIELDS; unresolved and summary are reports; skipped names sources that lack a side; qa is one row."""

    rows: DataFrame
    unresolved: DataFrame
    summary: DataFrame
    skipped: DataFrame
    qa: DataFrame


def place_in(reading_order: Column, page: Column) -> Column:
    """Place of a page, from 0, in a source's reading order of page names or files; ``text.NO_RANK`` where it is not in it."""
    at = F.array_position(F.transform(reading_order, text.stem), page)
    return F.when(at > 0, at - 1).otherwise(text.NO_RANK).cast("int")


def crop_order(listing: DataFrame, config: DataFrame, variants: bool = True) -> DataFrame:
    """source, page, line, name, image_path, new_name of the crops of known sources, and ``_key``, which sorts a source's crops.

    listing: path, name, in a folder for each source.  line counts from 1 within a page; the order is: place of the page in
    the reading order, its number, its side, the line's number, variants before the line itself, the name.  new_name is the
    name with that number.
    """
    found = readers.crops(listing.withColumn("source", text.base_name(text.parent(F.col("path")))), variants)
    found = found.join(config.select("source", "reading_order"), "source")
    keys = [*align.page_order(F.col("page"), place_in(F.col("reading_order"), F.col("page"))), F.col("line"), F.when(F.col("sub").isNull(), 1).otherwise(0), F.coalesce("sub", F.lit(0)), F.col("name")]
    keyed = found.withColumn("_key", F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)]))
    number = F.row_number().over(Window.partitionBy("source", "page").orderBy("_key"))  # a page has few lines
    placed = keyed.select("source", "page", "name", F.col("path").alias("image_path"), "_key", number.alias("line"))
    return placed.withColumn("new_name", text.padded_name(F.col("page"), F.col("line")))


def transcript_order(texts: DataFrame, config: DataFrame) -> DataFrame:
    """source, line_no, line: the lines of each known source's transcript that are not blank, white space collapsed; texts: path (as a URI), text."""
    named = texts.withColumn("transcript", text.base_name(text.plain_path(F.col("path")))).join(config.select("source", "transcript"), "transcript")
    return readers.transcript_lines(named, ["source"]).withColumn("line", text.collapse(F.col("line")))


def aligned_rows(crops: DataFrame, lines: DataFrame, config: DataFrame, by_page: bool = False) -> DataFrame:
    """FIELDS of the i-th crop of each source beside its i-th line, and of those without a partner.

    line is the place in the source, or with ``by_page`` the crop's number in its page.  A source that lacks a side gives nothing.
    """
    both = crops.select("source").distinct().intersect(lines.select("source").distinct())
    of = lambda df: df.join(both, "source", "left_semi")
    met = align.align(of(crops.withColumnRenamed("line", "page_line")), of(lines.withColumnRenamed("line", "said")), ["source"], [F.col("_key")], [F.col("line_no")])
    marks = F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair])
    line = F.coalesce("page_line", "pos") if by_page else F.col("pos")
    named = met.join(config.select("source", "source_id"), "source")
    return named.select("source", "source_id", F.coalesce("page", F.lit(NO_PAGE)).alias("page"), line.cast("int").alias("line"), F.coalesce("image_path", F.lit("")).alias("image_path"), F.coalesce("said", F.lit("")).alias("ground_truth_text"), marks[F.col("status")].alias("status"))


def unresolved(rows: DataFrame) -> DataFrame:
    """type, source, page, line, image_path, ground_truth_text of rows without a partner; null what there is none of."""
    kind = F.when(F.col("status") == STATUS[align.EXCESS_LEFT], "excess_crop").otherwise("excess_transcript")
    none = lambda c, gone: F.when(F.col(c) != gone, F.col(c)).alias(c)
    return rows.where(F.col("status") != STATUS[align.ALIGNED]).select(kind.alias("type"), "source", none("page", NO_PAGE), "line", none("image_path", ""), none("ground_truth_text", ""))


def summary(rows: DataFrame) -> DataFrame:
    """source, source_id, crop_lines, transcript_lines, aligned_rows, diff_crop_minus_transcript."""
    n = lambda x: F.count_if(F.col("status") != STATUS[x])
    crops, lines = n(align.EXCESS_RIGHT), n(align.EXCESS_LEFT)
    return rows.groupBy("source", "source_id").agg(crops.alias("crop_lines"), lines.alias("transcript_lines"), F.count_if(F.col("status") == STATUS[align.ALIGNED]).alias("aligned_rows"), (crops - lines).alias("diff_crop_minus_transcript"))


def skipped(crops: DataFrame, lines: DataFrame, config: DataFrame) -> DataFrame:
    """source, missing: sources of the configuration without crops, or without a transcript."""
    lacks = lambda df, what: config.select("source").join(df.select("source"), "source", "left_anti").withColumn("missing", F.lit(what))
    return lacks(crops, "crops").unionByName(lacks(lines, "transcript"))


def checked(rows: DataFrame, listing: DataFrame) -> DataFrame:
    """One row: rows, null_texts, empty_texts, duplicate_paths (rows after the first of a path), missing_files of the aligned rows."""
    own = rows.where(F.col("status") == STATUS[align.ALIGNED])
    by_path = own.groupBy("image_path").agg(F.count("*").alias("n"), F.count_if(F.col("ground_truth_text").isNull()).alias("nulls"), F.count_if(~text.present(F.col("ground_truth_text"))).alias("empty"))
    marked = by_path.join(listing.select(F.col("path").alias("image_path")).distinct().withColumn("there", F.lit(True)), "image_path", "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return marked.agg(total("n").alias("rows"), total("nulls").alias("null_texts"), total("empty").alias("empty_texts"), total(F.col("n") - 1).alias("duplicate_paths"), total(F.when(F.col("there").isNull(), F.col("n"))).alias("missing_files"))


def curated(listing: DataFrame, texts: DataFrame, config: DataFrame, variants: bool = True, by_page: bool = False) -> Curated:
    """The aligned table and its reports; listing: path, name; texts: path, text; config: CONFIG."""
    crops, lines = crop_order(listing, config, variants), transcript_order(texts, config)
    rows = staged(aligned_rows(crops, lines, config, by_page), "aligned")
    return Curated(rows, unresolved(rows), summary(rows), skipped(crops, lines, config), checked(rows, listing))


def write(found: Curated, out: str, keep_status: bool = True) -> str | None:
    """Writes rows, by_source, unresolved and summary below out as CSV; what stood at rows is kept, and where is returned.

    Without ``keep_status`` only aligned rows are written, without that column.
    """
    spark = found.rows.sparkSession
    kept = sinks.backup(spark, f"{out}/rows")
    rows = found.rows if keep_status else found.rows.where(F.col("status") == STATUS[align.ALIGNED]).drop("status")
    sinks.write_csv(rows, f"{out}/rows")
    sinks.write_by_source(rows, f"{out}/by_source")
    sinks.write_csv(found.unresolved, f"{out}/unresolved")
    sinks.write_csv(found.summary, f"{out}/summary")
    return kept


def curate(spark: SparkSession, crops: str, transcripts: str, config: DataFrame, out: str, variants: bool = True, by_page: bool = False, keep_status: bool = True) -> Curated:
    """Folders of crops, one for each source, and of transcripts to the tables of ``write``."""
    listing = readers.files(spark, crops, "*.[pP][nN][gG]", recursive=True)
    found = curated(listing, readers.whole_texts(spark, transcripts), config, variants, by_page)
    write(found, out, keep_status)
    return found


def renamed(spark: SparkSession, crops: str, config: DataFrame, out: str) -> DataFrame:
    """Copies crops under the numbers that their order gives them into a folder for each source below the URI out; paths written."""
    listing = readers.files(spark, crops, "*.[pP][nN][gG]", recursive=True, content=True)
    order = crop_order(listing.drop("content"), config)
    named = order.join(listing.select(F.col("path").alias("image_path"), "content"), "image_path").select(F.concat_ws("/", "source", "new_name").alias("name"), "content")
    return staged(sinks.write_files(named, "name", "content", out), "renamed")
