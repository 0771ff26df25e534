"""Alignment, splits, samples, batches and lookups over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.functions import text
from quire.operators import align, boxes, infer, quality, split
from quire.operators.order import numbered
from quire.plans.lines import LINES, lines, table

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


ALIGNED = """a AS (SELECT lang, doc_id AS left_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS pos FROM documents WHERE source = 'src1'),
b AS (SELECT lang, doc_id AS right_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS pos FROM documents WHERE source = 'src2'),
al AS (SELECT coalesce(a.lang, b.lang) AS lang, coalesce(a.pos, b.pos) AS pos, left_id, right_id, CASE WHEN b.pos IS NULL THEN 'excess_left' WHEN a.pos IS NULL THEN 'excess_right' ELSE 'aligned' END AS status FROM a FULL JOIN b ON a.lang = b.lang AND a.pos = b.pos)"""


def _documents_aligned(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    left, right = (docs.where(F.col("source") == s).select("lang", F.col("doc_id").alias(n)) for s, n in (("src1", "left_id"), ("src2", "right_id")))
    return align.align(left, right, ["lang"], [F.col("left_id")], [F.col("right_id")])


@query("align_full_outer", f"WITH {ALIGNED} SELECT lang, pos, left_id, right_id, status FROM al")
def align_full_outer(spark, sf_dir):
    return _documents_aligned(spark, sf_dir)


@query("align_unresolved", f"WITH {ALIGNED} SELECT lang, pos, coalesce(left_id, right_id) AS doc_id, status FROM al WHERE status <> 'aligned'")
def align_unresolved(spark, sf_dir):
    return align.unresolved(_documents_aligned(spark, sf_dir)).select("lang", "pos", F.coalesce("left_id", "right_id").alias("doc_id"), "status")


@query("align_summary", f"WITH {ALIGNED} SELECT lang, count(left_id) AS left_rows, count(right_id) AS right_rows, count(*) FILTER (WHERE status = 'aligned') AS aligned_rows, count(left_id) - count(right_id) AS diff FROM al GROUP BY lang")
def align_summary(spark, sf_dir):
    return align.summary(_documents_aligned(spark, sf_dir), ["lang"])


@query("align_inner", f"WITH {ALIGNED} SELECT lang, pos, left_id, right_id FROM al WHERE status = 'aligned'")
def align_inner(spark, sf_dir):
    return _documents_aligned(spark, sf_dir).where("status = 'aligned'").select("lang", "pos", "left_id", "right_id")


@query("align_conversations", """WITH u AS (SELECT conv_id, turn AS user_turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM conversations WHERE role = 'user'),
s AS (SELECT conv_id, turn AS reply_turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM conversations WHERE role = 'assistant')
SELECT coalesce(u.conv_id, s.conv_id) AS conv_id, coalesce(u.pos, s.pos) AS pos, user_turn, reply_turn, CASE WHEN s.pos IS NULL THEN 'excess_left' WHEN u.pos IS NULL THEN 'excess_right' ELSE 'aligned' END AS status FROM u FULL JOIN s ON u.conv_id = s.conv_id AND u.pos = s.pos""")
def align_conversations(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    left, right = (turns.where(F.col("role") == r).select("conv_id", F.col("turn").alias(n)) for r, n in (("user", "user_turn"), ("assistant", "reply_turn")))
    return align.align(left, right, ["conv_id"], [F.col("user_turn")], [F.col("reply_turn")])


CONFIG = [("en", "English", "English transcript"), ("fr", "French", "French transcript"), ("es", "Spanish", "Spanish transcript"), ("it", "Italian", "Italian transcript")]
VALUES = "c(lang, source_id, transcript) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in CONFIG) + ")"


def _config(spark):
    return F.broadcast(spark.createDataFrame(CONFIG, "lang string, source_id string, transcript string"))  # four rows


@query("config_lookup", f"WITH {VALUES} SELECT doc_id, d.lang, source_id, transcript FROM documents d JOIN c ON d.lang = c.lang")
def config_lookup(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(_config(spark), "lang").select("doc_id", "lang", "source_id", "transcript")


@query("config_skipped", f"WITH {VALUES} SELECT lang, 'no config' AS reason, count(*) AS n FROM documents WHERE lang NOT IN (SELECT lang FROM c) GROUP BY lang UNION ALL SELECT lang, 'no rows', 0 FROM c WHERE lang NOT IN (SELECT lang FROM documents)")
def config_skipped(spark, sf_dir):
    docs, config = table(spark, sf_dir, "documents").select("lang"), _config(spark)
    left = docs.join(config, "lang", "left_anti").groupBy("lang").agg(F.count("*").alias("n")).select("lang", F.lit("no config").alias("reason"), "n")
    return left.unionByName(config.join(docs.distinct(), "lang", "left_anti").select("lang", F.lit("no rows").alias("reason"), F.lit(0).cast("long").alias("n")))


@query("labelled_semi", "SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def labelled_semi(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")


@query("unlabelled_anti", "SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unlabelled_anti(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("labelled_mark", "SELECT source, count(*) AS n, count(l.id) AS labelled, count(*) - count(l.id) AS unlabelled FROM documents LEFT JOIN (SELECT DISTINCT doc_id AS id FROM labels) l ON doc_id = id GROUP BY source")
def labelled_mark(spark, sf_dir):
    marked = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("found", F.lit(True)), "doc_id", "left")
    return marked.groupBy("source").agg(F.count("*").alias("n"), F.count("found").alias("labelled"), F.count_if(F.col("found").isNull()).alias("unlabelled"))


PRIORITIES = ["1-URGENT", "3-MEDIUM", "2-HIGH"]


@query("reading_order_rank", "SELECT o_orderkey, o_orderpriority, CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '3-MEDIUM' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 10000 END AS INTEGER) AS page_rank FROM orders")
def reading_order_rank(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", align.rank_in(F.col("o_orderpriority"), PRIORITIES).alias("page_rank"))


@query("qa_counters", "SELECT count(*) AS rows, count(*) FILTER (WHERE text IS NULL) AS null_texts, count(*) FILTER (WHERE trim(text) = '') AS blank_texts, count(*) - (SELECT count(*) FROM (SELECT DISTINCT text FROM documents)) AS duplicate_texts, count(*) FILTER (WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS missing FROM documents")
def qa_counters(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("text").isNull(), None).when(F.trim("text") == "", "").otherwise(F.sha2("text", 256)).alias("text"))
    marked = docs.join(table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("found", F.lit(True)), "doc_id", "left")
    return quality.counters(marked, "text", F.col("found").isNotNull())


NATURAL = "list_aggregate(list_transform(regexp_extract_all(lower(url), '(\\d+|\\D+)'), lambda p: CASE WHEN regexp_matches(p, '^\\d') THEN lpad(p, CAST(greatest(20, length(p)) AS INTEGER), '0') ELSE p END), 'string_agg', '')"


@query("natural_sort_rank", f"SELECT page_id, url, row_number() OVER (ORDER BY {NATURAL}, page_id) AS natural_rank FROM pages")
def natural_sort_rank(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url").withColumn("_key", text.natural_key(F.col("url")))
    return numbered(pages, [], [F.col("_key"), F.col("page_id")], "natural_rank").drop("_key")


PAGE = "CAST(l_linenumber AS VARCHAR) || CASE l_returnflag WHEN 'A' THEN '' WHEN 'N' THEN 'Left' ELSE 'x' END"


@query("composite_sort_rank", f"""WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, {PAGE} AS page, l_linestatus FROM lineitem)
SELECT l_orderkey, l_linenumber, page, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_linestatus WHEN 'O' THEN 0 ELSE 10000 END, l_linenumber, CASE WHEN page LIKE '%Left' THEN 1 WHEN page LIKE '%x' THEN 3 ELSE 0 END, l_partkey % 7, CASE WHEN l_partkey % 3 = 0 THEN 0 ELSE 1 END, l_partkey, page) AS place FROM p""")
def composite_sort_rank(spark, sf_dir):
    """Seven keys: reading-order rank, page number, side, line, variant before its base, variant number, name; within an order, which is small."""
    side = F.when(F.col("l_returnflag") == "A", "").when(F.col("l_returnflag") == "N", "Left").otherwise("x")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_linestatus", F.concat(F.col("l_linenumber").cast("string"), side).alias("page"))
    keys = [*align.page_order(F.col("page"), align.rank_in(F.col("l_linestatus"), ["O"])), F.col("l_partkey") % 7, F.when(F.col("l_partkey") % 3 == 0, 0).otherwise(1), F.col("l_partkey"), F.col("page")]
    return rows.select("l_orderkey", "l_linenumber", "page", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*keys)).cast("long").alias("place"))


@query("canonical_sort_rank", f"""WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, {PAGE} AS page, l_linestatus FROM lineitem)
SELECT l_orderkey, l_linenumber, page, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_linestatus WHEN 'O' THEN 0 ELSE 10000 END, l_linenumber, CASE WHEN page LIKE '%Left' THEN 1 WHEN page LIKE '%x' THEN 3 ELSE 0 END, l_partkey % 7, page, l_partkey) AS place FROM p""")
def canonical_sort_rank(spark, sf_dir):
    """Rows without variants: reading-order rank, page number, side, line, name; within an order, which is small."""
    side = F.when(F.col("l_returnflag") == "A", "").when(F.col("l_returnflag") == "N", "Left").otherwise("x")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_linestatus", F.concat(F.col("l_linenumber").cast("string"), side).alias("page"))
    keys = [*align.page_order(F.col("page"), align.rank_in(F.col("l_linestatus"), ["O"])), F.col("l_partkey") % 7, F.col("page"), F.col("l_partkey")]
    return rows.select("l_orderkey", "l_linenumber", "page", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*keys)).cast("long").alias("place"))


@query("renumber_in_page", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber) AS line, 'p' || l_orderkey || printf('_line_%03d', row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber)) || '.png' AS new_name FROM lineitem")
def renumber_in_page(spark, sf_dir):
    line = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_linenumber")).cast("long")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", line.alias("line"))
    return rows.withColumn("new_name", text.padded_name(F.concat(F.lit("p"), F.col("l_orderkey").cast("string")), F.col("line")))


@query("region_suffix", "WITH r AS (SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_linenumber) AS INTEGER) AS region_no, CAST(count(*) OVER (PARTITION BY l_orderkey) AS INTEGER) AS regions FROM lineitem) SELECT *, CASE WHEN regions = 1 THEN 'full' WHEN regions = 2 AND region_no = 1 THEN 'left' WHEN regions = 2 THEN 'right' ELSE 'col' || region_no END AS suffix FROM r")
def region_suffix(spark, sf_dir):
    return boxes.region_names(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), ["l_orderkey"], [F.col("l_extendedprice"), F.col("l_linenumber")]).drop("l_extendedprice")


@query("clamp_bbox", "SELECT l_orderkey, l_linenumber, CAST(greatest(0, trunc(l_quantity) - 5) AS INTEGER) AS x1, CAST(greatest(0, trunc(l_discount * 100) - 5) AS INTEGER) AS y1, CAST(least(1000, trunc(l_quantity * 30) + 5) AS INTEGER) AS x2, CAST(least(800, trunc(l_extendedprice / 50) + 5) AS INTEGER) AS y2 FROM lineitem")
def clamp_bbox(spark, sf_dir):
    box = boxes.clamp(F.col("l_quantity"), F.col("l_discount") * 100, F.col("l_quantity") * 30, F.col("l_extendedprice") / 50, F.lit(1000), F.lit(800))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *box)


BATCHES = "b AS (SELECT conv_id, turn, coalesce(text, '') AS t, (row_number() OVER (ORDER BY conv_id, turn) - 1) // 35 AS batch, CAST((row_number() OVER (ORDER BY conv_id, turn) - 1) % 35 + 1 AS INTEGER) AS slot FROM conversations)"


def _batches(spark, sf_dir):
    return infer.batched(table(spark, sf_dir, "conversations"), [F.col("conv_id"), F.col("turn")])


@query("batch_35", f"WITH {BATCHES} SELECT conv_id, turn, batch, slot FROM b")
def batch_35(spark, sf_dir):
    return _batches(spark, sf_dir).select("conv_id", "turn", "batch", "slot")


@query("batch_count", "SELECT count(*) AS n, CAST(ceil(count(*) / 35.0) AS BIGINT) AS batches FROM conversations")
def batch_count(spark, sf_dir):
    return table(spark, sf_dir, "conversations").agg(F.count("*").alias("n")).select("n", F.ceil(F.col("n") / 35).cast("long").alias("batches"))


@query("batch_json_roundtrip", f"WITH {BATCHES} SELECT batch, slot, t AS text FROM b")
def batch_json_roundtrip(spark, sf_dir):
    """Batches as JSON arrays and back, as a model would be asked and answer."""
    return infer.from_messages(infer.to_messages(_batches(spark, sf_dir), "text"))


@query("batch_correction", f"WITH {BATCHES} SELECT conv_id, turn, replace(t, 'th', 'tn') AS corrected FROM b")
def batch_correction(spark, sf_dir):
    """A stand-in model called by batch, with validation and fall-back."""
    rows = _batches(spark, sf_dir).select("conv_id", "turn", "batch", "slot", "text")
    return infer.corrected(rows, "text", lambda texts: [t.replace("th", "tn") for t in texts]).select("conv_id", "turn", "corrected")


@query("stratified_split", "WITH r AS (SELECT doc_id, lang, contains(text, chr(10)) AS multi, row_number() OVER (PARTITION BY lang, contains(text, chr(10)) ORDER BY md5('42:' || doc_id), doc_id) AS pos, count(*) OVER (PARTITION BY lang, contains(text, chr(10))) AS n FROM documents), t AS (SELECT *, greatest(1, round_even(n * 0.8::DOUBLE, 0)) AS k FROM r) SELECT doc_id, lang, multi, CASE WHEN pos <= CASE WHEN n >= 2 THEN least(k, n - 1) ELSE k END THEN 'train' ELSE 'val' END AS split FROM t")
def stratified_split(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.contains("text", F.lit("\n")).alias("multi"))
    return split.stratified(docs, ["lang", "multi"], "doc_id")


GROUPS = "v AS (SELECT source AS s FROM (SELECT DISTINCT source FROM documents) ORDER BY md5('42:' || coalesce(source, '')), source LIMIT 2), g AS (SELECT doc_id, source, CASE WHEN source IN (SELECT s FROM v) THEN 'val' ELSE 'train' END AS split FROM documents)"


def _grouped(spark, sf_dir):
    return split.by_group(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", 2)


@query("group_split", f"WITH {GROUPS} SELECT doc_id, source, split FROM g")
def group_split(spark, sf_dir):
    return _grouped(spark, sf_dir)


@query("replicate_train", f"WITH {GROUPS} SELECT doc_id, source, split, CAST(aug AS INTEGER) AS aug_id, aug > 0 AS is_augmented FROM (SELECT *, unnest(CASE WHEN split = 'train' THEN [1, 2, 3, 4, 5] ELSE [0] END) AS aug FROM g)")
def replicate_train(spark, sf_dir):
    return split.replicate(_grouped(spark, sf_dir), 5)


@query("manifest_sizes", f"WITH {GROUPS} SELECT split, count(*) AS n FROM g GROUP BY split UNION ALL SELECT 'full', count(*) FROM g")
def manifest_sizes(spark, sf_dir):
    """Rows of the train, val and full manifests."""
    held = _grouped(spark, sf_dir)
    return held.groupBy("split").agg(F.count("*").alias("n")).unionByName(held.agg(F.lit("full").alias("split"), F.count("*").alias("n")))


@query("seeded_sample", "SELECT doc_id, lang, source FROM documents ORDER BY md5('7:' || doc_id), doc_id LIMIT 20")
def seeded_sample(spark, sf_dir):
    return split.sample(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), 20, 7, "doc_id")


@query("first_rows", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 10")
def first_rows(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang").orderBy("doc_id").limit(10)


@query("set_operations", "SELECT 'train' AS side, count(*) AS n FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT 'both', count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels) UNION ALL SELECT 'langs', count(DISTINCT lang) FROM documents UNION ALL SELECT 'all', (SELECT count(*) FROM documents) + (SELECT count(*) FROM labels)")
def set_operations(spark, sf_dir):
    docs, labels = (table(spark, sf_dir, t).select("doc_id") for t in ("documents", "labels"))
    counted = lambda df, side: df.agg(F.lit(side).alias("side"), F.count("*").alias("n"))
    out = counted(docs.subtract(labels), "train").unionByName(counted(docs.intersect(labels), "both"))
    return out.unionByName(counted(table(spark, sf_dir, "documents").select("lang").where("lang is not null").distinct(), "langs")).unionByName(counted(docs.unionByName(labels), "all"))


@query("transcript_lines", f"WITH {LINES} SELECT source, count(*) AS lines, CAST(max(length(ref)) AS INTEGER) AS longest, CAST(sum(length(ref)) AS BIGINT) AS chars FROM h GROUP BY source")
def transcript_lines(spark, sf_dir):
    return lines(spark, sf_dir).groupBy("source").agg(F.count("*").alias("lines"), F.max(F.length("ref")).alias("longest"), F.sum(F.length("ref")).cast("long").alias("chars"))


@query("page_overlap", "SELECT lang, count(*) AS ids FROM (SELECT DISTINCT lang, l.doc_id FROM documents d JOIN labels l ON l.doc_id = d.doc_id) GROUP BY lang")
def page_overlap(spark, sf_dir):
    """Documents, by language, that both sides have: pages of transcripts and of crops."""
    return align.overlap(table(spark, sf_dir, "documents").select("lang", "doc_id"), table(spark, sf_dir, "labels").select("doc_id"), ["doc_id"]).groupBy("lang").agg(F.count("*").alias("ids"))
