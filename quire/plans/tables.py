"""Scalar functions, JSON manifests, curves and aggregates over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text
from quire.operators import boxes, quality
from quire.plans.lines import table

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


@query("slugify", "SELECT p_partkey, coalesce(nullif(regexp_replace(regexp_replace(lower(trim(p_name)), '\\s+', '_', 'g'), '[^a-z0-9_-]', '', 'g'), ''), 'unknown') AS slug, trim(regexp_replace(p_type || '/' || p_brand, '[^A-Za-z0-9]+', '_', 'g'), '_') AS safe FROM part")
def slugify(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.slug(F.col("p_name")).alias("slug"), text.file_safe(F.concat_ws("/", "p_type", "p_brand")).alias("safe"))


@query("path_parts", "WITH n AS (SELECT page_id, url, regexp_extract(url, '[^/]*$') AS name FROM pages) SELECT page_id, name, CASE WHEN length(regexp_extract(name, '^(.+)\\.[^.]*$', 1)) > 0 THEN regexp_extract(name, '^(.+)\\.[^.]*$', 1) ELSE name END AS stem, regexp_replace(url, '/?[^/]*$', '') AS parent FROM n")
def path_parts(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", text.base_name(url).alias("name"), text.stem(url).alias("stem"), text.parent(url).alias("parent"))


@query("regex_groups", "SELECT page_id, nullif(regexp_extract(url, '/([a-z]{2})/', 1), '') AS lang, CAST(nullif(regexp_extract(url, '/(\\d+)', 1), '') AS BIGINT) AS number, nullif(regexp_extract(url, '[?&]page=(\\d+)', 1), '') AS page FROM pages")
def regex_groups(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", text.group_of(url, "/([a-z]{2})/").alias("lang"), text.group_of(url, r"/(\d+)").cast("long").alias("number"), text.group_of(url, r"[?&]page=(\d+)").alias("page"))


@query("collapse_ws", "SELECT doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS digest, CAST(length(text) - length(replace(text, chr(10), '')) AS INTEGER) AS newlines, CAST(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS INTEGER) AS n_words FROM documents")
def collapse_ws(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.collapse(F.col("text"))).alias("digest"), (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))).alias("newlines"), F.size(text.words(F.col("text"))).alias("n_words"))


@query("json_manifest", "SELECT event_type AS source, 'p' || user_id AS page, event_id, value AS x1, value + 10 AS x2, 0.25::DOUBLE + (event_id % 4) / 8.0::DOUBLE AS conf FROM events WHERE (event_id % 8) / 8.0::DOUBLE >= 0.25 AND event_id % 8 < 8 AND (event_id % 8) >= 2 AND value IS NOT NULL AND 1 = 1 AND 0.25::DOUBLE + (event_id % 4) / 8.0::DOUBLE >= 0.25")
def json_manifest(spark, sf_dir):
    """A detection manifest built as JSON for every event, parsed, exploded and filtered by confidence."""
    conf = F.when(F.col("event_id") % 8 >= 2, F.lit(0.25) + (F.col("event_id") % 4) / 8.0).otherwise(0.1)
    box = F.array("value", F.lit(0.0), F.col("value") + 10, F.lit(5.0), conf)
    page = F.struct(F.col("event_id").cast("string").alias("path"), F.array(box).alias("boxes"))
    raw = table(spark, sf_dir, "events").where("value is not null").select(F.to_json(F.create_map("event_type", F.create_map(F.concat(F.lit("p"), F.col("user_id").cast("string")), page))).alias("json"))
    return boxes.manifest_rows(raw, "json").select("source", "page", F.col("path").cast("long").alias("event_id"), "x1", "x2", "conf")


@query("event_properties", "SELECT event_type, count(*) AS n, count(*) FILTER (WHERE props IS NOT NULL AND json_valid(props)) AS with_props FROM events GROUP BY event_type")
def event_properties(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.get_json_object("props", "$").isNotNull()).alias("with_props"))


@query("early_stop", """WITH s AS (SELECT user_id, value, row_number() OVER w AS step, min(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
l AS (SELECT *, max(CASE WHEN best IS NULL OR value < best THEN step END) OVER (PARTITION BY user_id ORDER BY step) AS last FROM s),
t AS (SELECT *, min(CASE WHEN step - last >= 8 THEN step END) OVER (PARTITION BY user_id) AS stop_step FROM l),
v AS (SELECT * FROM t WHERE stop_step IS NULL OR step <= stop_step)
SELECT user_id, CAST(arg_min(step, (value, step)) AS INTEGER) AS best_step, round(min(value), 6) AS best_value, CAST(any_value(stop_step) AS INTEGER) AS stop_step FROM v GROUP BY user_id""")
def early_stop(spark, sf_dir):
    return quality.early_stop(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value", 8).withColumn("best_value", F.round("best_value", 6))


@query("best_epoch", "SELECT user_id, CAST(arg_min(event_id, (value, event_id)) AS BIGINT) AS best_event, round(min(value), 6) AS best_value FROM events GROUP BY user_id")
def best_epoch(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.min_by("event_id", F.struct("value", "event_id")).alias("best_event"), F.round(F.min("value"), 6).alias("best_value"))


@query("filtered_sum", "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity) FILTER (WHERE l_discount > 0.05), 4) AS discounted, round(sum(l_quantity), 4) AS quantity, max(l_extendedprice) AS dearest FROM lineitem GROUP BY l_returnflag")
def filtered_sum(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum(F.when(F.col("l_discount") > 0.05, F.col("l_quantity"))), 4).alias("discounted"), F.round(F.sum("l_quantity"), 4).alias("quantity"), F.max("l_extendedprice").alias("dearest"))


@query("rows_per_key", "SELECT conv_id, count(*) AS turns, string_agg(role, ',' ORDER BY turn) AS roles, max(turn) AS last_turn FROM conversations GROUP BY conv_id")
def rows_per_key(spark, sf_dir):
    held = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("x"), F.max("turn").alias("last_turn"))
    return held.select("conv_id", "turns", F.array_join("x.role", ",").alias("roles"), "last_turn")


@query("distinct_sources", "SELECT DISTINCT source FROM documents")
def distinct_sources(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("source").distinct().orderBy("source")


@query("last_candidate", "SELECT p_brand, max(p_name) AS last_name, max(CASE WHEN contains(p_name, 'blue') THEN p_name END) AS last_blue, coalesce(max(CASE WHEN contains(p_name, 'blue') THEN p_name END), max(p_name)) AS chosen FROM part GROUP BY p_brand")
def last_candidate(spark, sf_dir):
    blue = F.max(F.when(F.contains("p_name", F.lit("blue")), F.col("p_name")))
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.max("p_name").alias("last_name"), blue.alias("last_blue"), F.coalesce(blue, F.max("p_name")).alias("chosen"))


@query("label_restoration", "SELECT vec_id, CAST(list_sum(list_transform(embedding, lambda x: CASE WHEN floor(x * 100) = -100 THEN 1 ELSE floor(x * 100) END)) AS BIGINT) AS total FROM embeddings")
def label_restoration(spark, sf_dir):
    """Padding marks (-100) in label arrays replaced by the pad id."""
    labels = F.transform("embedding", lambda x: F.floor(x * F.lit(100).cast("float")))  # in single precision, as they are stored
    restored = F.transform(labels, lambda x: F.when(x == -100, F.lit(1).cast("long")).otherwise(x))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.aggregate(restored, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("source_sizes", "SELECT source, count(*) AS n, CAST(sum(strlen(text)) AS BIGINT) AS bytes, round(sum(strlen(text)) / 1048576.0::DOUBLE, 6) AS mb FROM documents GROUP BY source")
def source_sizes(spark, sf_dir):
    out = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).cast("long").alias("bytes"))
    return out.withColumn("mb", F.round(F.col("bytes") / 1048576.0, 6))
