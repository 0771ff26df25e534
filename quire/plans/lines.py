"""Lines of documents as reference texts, with hypotheses of a deterministic recogniser stand-in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import strip, words

#: words of a piece, where the quadratic distance of words is checked by SQL, which has one byte for each
WORDS = 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt to all cores where they come in fewer files than there are cores; else as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def misread(text: Column) -> Column:
    """What a poor recogniser makes of a line: ASCII confusions, and blanks lost behind commas."""
    return F.replace(F.replace(F.translate(text, "vjVJ", "uiUI"), F.lit("th"), F.lit("tn")), F.lit(", "), F.lit(","))


def misread_less(text: Column) -> Column:
    return F.replace(F.translate(text, "v", "u"), F.lit("tion"), F.lit("tiom"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))
    rows = rows.select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("line_no", "t"))
    return rows.select("doc_id", "lang", "source", F.col("line_no").cast("long").alias("line_no"), strip(F.col("t")).alias("t")).where("t != ''")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, line_no, ref, hyp, hyp2 of every whole line, stripped, blank ones dropped."""
    return _texts(spark, sf_dir).select("doc_id", "lang", "source", "line_no", F.col("t").alias("ref"), misread(F.col("t")).alias("hyp"), misread_less(F.col("t")).alias("hyp2"))


def pieces(spark: SparkSession, sf_dir: str, size: int = WORDS) -> DataFrame:
    """doc_id, lang, source, line_no, piece, ref, hyp: all lines in pieces of ``size`` words, white space between them as one space."""
    rows = _texts(spark, sf_dir).withColumn("w", words(F.col("t")))
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / size).cast("int"))))
    ref = F.array_join(F.slice("w", F.col("piece") * size + 1, F.lit(size)), " ")
    return rows.select("doc_id", "lang", "source", "line_no", F.col("piece").cast("long").alias("piece"), ref.alias("ref"), misread(ref).alias("hyp"))


#: the same rows in SQL
KEPT = r"""raw AS (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS l, unnest(range(0, len(string_split(text, chr(10))))) AS line_no FROM documents),
kept AS (SELECT doc_id, lang, source, line_no, regexp_replace(l, '^\s+|\s+$', '', 'g') AS t FROM raw),"""
MISREAD = "replace(replace(translate(ref, 'vjVJ', 'uiUI'), 'th', 'tn'), ', ', ',') AS hyp, replace(translate(ref, 'v', 'u'), 'tion', 'tiom') AS hyp2"
LINES = f"""{KEPT} refs AS (SELECT doc_id, lang, source, line_no, t AS ref FROM kept WHERE t <> ''),
h AS (SELECT *, {MISREAD} FROM refs)"""
PIECES = rf"""{KEPT} parts AS (SELECT doc_id, lang, source, line_no, list_filter(string_split_regex(t, '\s+'), lambda x: x <> '') AS w FROM kept WHERE t <> ''),
cut AS (SELECT *, unnest(range(0, (len(w) - 1) // {WORDS} + 1)) AS piece FROM parts),
refs AS (SELECT doc_id, lang, source, line_no, piece, array_to_string(w[piece * {WORDS} + 1 : piece * {WORDS} + {WORDS}], ' ') AS ref FROM cut),
h AS (SELECT *, {MISREAD} FROM refs)"""
#: distance of characters of two columns, each distinct one (listed in column k) as one byte, as the SQL distance counts bytes
BYTES = "array_to_string(list_transform(string_split({0}, ''), lambda c: chr(CAST(1 + list_position(k, c) AS INTEGER))), '')"
DISTANCE = f"levenshtein({BYTES.format('{0}')}, {BYTES.format('{1}')})"
TOKENS = r"""list_filter(string_split_regex({0}, '\s+'), lambda x: x <> '')"""
CODED = "array_to_string(list_transform({0}, lambda w: chr(CAST(32 + list_position(list_distinct(list_concat(rw, hw)), w) AS INTEGER))), '')"
EDITS = f"""tok AS (SELECT *, {TOKENS.format('ref')} AS rw, {TOKENS.format('hyp')} AS hw FROM h),
e AS (SELECT *, CAST(levenshtein(ref, hyp) AS BIGINT) AS c_edits, greatest(1, length(ref)) AS c_len, CAST(levenshtein({CODED.format('rw')}, {CODED.format('hw')}) AS BIGINT) AS w_edits, greatest(1, len(rw)) AS w_len FROM tok)"""
#: n-gram counts of every line and side: keys doc_id, line_no, n
GRAMS = """gr AS (SELECT doc_id, source, line_no, n, substr(ref, CAST(i AS BIGINT), n) AS g, count(*) AS c FROM (SELECT *, unnest(range(1, length(ref) - n + 2)) AS i FROM {0}, (SELECT unnest(range(1, 7)) AS n)) GROUP BY ALL),
gh AS (SELECT doc_id, source, line_no, n, substr(hyp, CAST(i AS BIGINT), n) AS g, count(*) AS c FROM (SELECT *, unnest(range(1, length(hyp) - n + 2)) AS i FROM {0}, (SELECT unnest(range(1, 7)) AS n)) GROUP BY ALL),
gm AS (SELECT doc_id, source, line_no, n, CAST(sum(least(gr.c, gh.c)) AS BIGINT) AS m FROM gr JOIN gh USING (doc_id, source, line_no, n, g) GROUP BY ALL),
gs AS (SELECT doc_id, source, line_no, n, CAST(sum(m) AS BIGINT) AS m, CAST(sum(r) AS BIGINT) AS r, CAST(sum(h) AS BIGINT) AS h FROM (
  SELECT doc_id, source, line_no, n, m, 0 AS r, 0 AS h FROM gm
  UNION ALL SELECT doc_id, source, line_no, n, 0, c, 0 FROM gr UNION ALL SELECT doc_id, source, line_no, n, 0, 0, c FROM gh) GROUP BY ALL)"""
