"""The operators as queries over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import chat_format, decontaminate, embedding_dedup, fingerprints, line_dedup, lm_scoring, mixing, ngram_join, packing, spelling, structure_repair, toxicity, url_filter

Query = Callable[[SparkSession, str], DataFrame]
PROBE = "\\### Assistant: </turn> ok"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, dealt to all cores, in one order, where they come in fewer files than there are cores."""
    docs, cores = _table(spark, sf_dir, "documents"), spark.sparkContext.defaultParallelism
    return docs.repartition(cores).sortWithinPartitions("doc_id", F.xxhash64("text")) if len(docs.inputFiles()) < cores else docs


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(_table(spark, sf_dir, "documents"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_components(_documents(spark, sf_dir))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").selectExpr("cast(conv_id as bigint) conv_id", "cast(turn as bigint) turn", "role", "text")
    probe = spark.range(2).selectExpr("cast(-7 as bigint) conv_id", "id turn", "if(id = 0, 'user', 'assistant') role").withColumn("text", F.lit(PROBE))
    out = chat_format.format_conversations(turns.unionByName(probe))
    out = out.select("conv_id", "formatted", F.explode(F.array(F.struct(chat_format.read_turns(F.col("formatted")).alias("turns"), chat_format.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss")))).alias("x"))
    said = F.array_join(F.transform("x.turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("x.turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("x.loss").cast("long").alias("loss_chars"), F.sha2(F.col("x.loss"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    scored = toxicity.score_documents(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(_documents(spark, sf_dir))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"), mixing.quality_weights(_table(spark, sf_dir, "labels")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(_documents(spark, sf_dir))


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure_repair.damaged_report(_table(spark, sf_dir, "conversations"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(_documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.vocabulary(_documents(spark, sf_dir), spelling.one_letter_lost))


_OP2 = """
WITH cut AS (
  SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cut
), rules(verdict, rule, h, p) AS (VALUES ('allow', 'com/', 'com', '/'), ('block', 'example.com/en/', 'example.com', '/en/'),
  ('allow', 'www.example.com/en/', 'www.example.com', '/en/'), ('block', 'net/es/', 'net', '/es/'), ('block', 'net/fr/', 'net', '/fr/'))
SELECT page_id, host, path,
  (SELECT max_by(rule, length(rule)) FROM rules WHERE ends_with('.' || host, '.' || h) AND starts_with(path, p)) AS rule,
  coalesce((SELECT max_by(verdict, length(rule)) FROM rules WHERE ends_with('.' || host, '.' || h) AND starts_with(path, p)), 'allow') AS verdict
FROM split"""

_OP4 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), m AS (
  SELECT *, row_number() OVER w AS i, lag(role) OVER w AS before,
    length(replace(replace(role, '\', '\\'), '<|', '<\|')) AS er, length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS et
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(et + CASE WHEN before IS NOT DISTINCT FROM role AND i > 1 THEN 8 ELSE er + 25 END) AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id"""

_OP9 = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size,
    CASE WHEN q IS NULL THEN 1.0::DOUBLE WHEN q >= 1 THEN 2.0::DOUBLE ELSE 0.5::DOUBLE END AS weight
  FROM documents LEFT JOIN (SELECT doc_id AS id, max(quality) AS q FROM labels GROUP BY 1) ON doc_id = id
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM d GROUP BY source
), l AS (
  SELECT *, 2 * source_size / w AS cap, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY 2 * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s
), t AS (
  SELECT source, source_size, least(CAST(2 * source_size AS DOUBLE), coalesce(w * (SELECT min_by(level, cap) FROM l WHERE level <= cap), 0)) AS target FROM l
), p AS (
  SELECT source, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target + 0.5) AS BIGINT) // source_size ELSE 0 END AS epochs, CAST(floor(target + 0.5) AS BIGINT) AS budget FROM t
), o AS (
  SELECT doc_id, size, source_size, target, epochs, budget - epochs * source_size AS rest,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY -ln((CAST('0x' || substr(md5('17:' || doc_id), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0) / weight, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM o"""


_OP3 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w
), rows AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM rows a JOIN rows b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach(id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.id, links.b FROM reach JOIN links ON reach.r = links.a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id FROM sets JOIN (SELECT id, min(r) AS component_id FROM reach GROUP BY id) ON id = doc_id"""

_OP6 = """
WITH RECURSIVE d AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
v AS (SELECT * FROM d WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0
), links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.93
), reach(id, r) AS (SELECT vec_id, vec_id FROM d UNION SELECT reach.id, links.b FROM reach JOIN links ON reach.r = links.a)
SELECT id AS vec_id, (SELECT count(*) FROM links WHERE a = id) AS n_links, min(r) AS component_id, min(r) = id AS kept FROM reach GROUP BY id"""

_OP11 = r"""
WITH RECURSIVE table32 AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t
), keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations
), kinds AS (
  SELECT conv_id, turn, role, text, xor(4294967295, list_reduce(list_transform(range(strlen(k)), lambda i: ord(k[i + 1])::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295)) % 20 AS kind FROM keyed, table32
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM kinds
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM damaged
), again AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) AS seen FROM placed
), faults AS (
  SELECT conv_id, turn, role, text, pos, left(role, 1) AS i, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN seen > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM again
), stats AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate,
    count(*) FILTER (WHERE fault = 't') AS truncated, count(*) FILTER (WHERE before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv_id
), runs(state, ins, said, mid, next) AS (VALUES ('', '', [], '', 'user'), ('', 'I', ['user:'], 'u', 'assistant'), ('', 'II', ['user:', 'assistant:'], 'a', 'user'),
  ('s', '', [], 's', 'user'), ('s', 'I', ['user:'], 'u', 'assistant'), ('s', 'II', ['user:', 'assistant:'], 'a', 'user'),
  ('u', '', [], 'u', 'assistant'), ('u', 'I', ['assistant:'], 'a', 'user'), ('u', 'II', ['assistant:', 'user:'], 'u', 'assistant'),
  ('a', '', [], 'a', 'user'), ('a', 'I', ['user:'], 'u', 'assistant'), ('a', 'II', ['user:', 'assistant:'], 'a', 'user')
), edits(x) AS (VALUES ('D'), ('K'), ('R')
), best(conv_id, pos, state, b) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, '', {'cost': 0::BIGINT, 'audit': '', 'said': []::VARCHAR[]} FROM conversations
  UNION ALL
  SELECT conv_id, pos, state, min(b) FROM (
    SELECT best.conv_id, f.pos, CASE x WHEN 'D' THEN mid WHEN 'R' THEN left(next, 1) ELSE f.i END AS state,
      {'cost': (b.cost + 3 * length(ins) + CASE x WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN x <> 'D' AND f.fault = 't' THEN 3 ELSE 0 END)::BIGINT, 'audit': b.audit || ins || x,
       'said': b.said || runs.said || CASE x WHEN 'D' THEN [] WHEN 'R' THEN [next || ':' || f.text] ELSE [f.role || ':' || f.text] END} AS b
    FROM best JOIN faults f ON best.conv_id IS NOT DISTINCT FROM f.conv_id AND f.pos = best.pos + 1 JOIN runs ON runs.state = best.state, edits
    WHERE x = 'D' OR (coalesce(f.fault, '') NOT IN ('b', 'd') AND (x = 'R' OR (mid = '' AND f.i IN ('s', 'u')) OR (mid IN ('s', 'a') AND f.i = 'u') OR (mid = 'u' AND f.i = 'a')))
  ) GROUP BY conv_id, pos, state
), ends AS (
  SELECT conv_id, min({'cost': (b.cost + 3 * length(ins))::BIGINT, 'audit': b.audit || ins, 'said': b.said || runs.said}) AS b
  FROM best JOIN runs USING (state) WHERE mid IN ('', 'a') AND pos = (SELECT count(*) FROM faults f WHERE f.conv_id IS NOT DISTINCT FROM best.conv_id) GROUP BY conv_id
)
SELECT ends.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, b.cost AS cost, b.audit AS audit,
  sha256(array_to_string(b.said, chr(10))) AS repaired_sha256 FROM ends LEFT JOIN stats ON ends.conv_id IS NOT DISTINCT FROM stats.conv_id"""


_OP12 = r"""
WITH dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), iw AS (
  SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, unnest(list_transform(range(1, greatest(len(w) - 10, 0) + 2), lambda s: array_to_string(w[s:s + 9], ' '))) AS g FROM iw WHERE len(w) > 0
), places AS (
  SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM dw, (SELECT DISTINCT n FROM windows))
), found AS (SELECT doc_id, p, n, item FROM places JOIN windows USING (n, g)
), hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, p, n FROM found)) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id
), pw AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM dw
), counts AS (SELECT word, count(*) AS n FROM pw GROUP BY word
), rare AS (
  SELECT item, word, n, count(*) OVER (PARTITION BY item) AS k FROM (
    SELECT item, word, coalesce(n, 0) AS n, row_number() OVER (PARTITION BY item ORDER BY coalesce(n, 0), word) AS i FROM (SELECT DISTINCT item, unnest(w) AS word FROM iw) LEFT JOIN counts USING (word)) WHERE i <= 4
), spots AS (SELECT doc_id, item, k, word, p FROM rare JOIN pw USING (word) WHERE k > 1
), near AS (
  SELECT doc_id, count(DISTINCT item) AS near_items FROM (
    SELECT a.doc_id, a.item FROM spots a JOIN spots b ON a.doc_id = b.doc_id AND a.item = b.item AND b.p BETWEEN a.p AND a.p + 39 GROUP BY a.doc_id, a.item, a.p, a.k HAVING count(DISTINCT b.word) = a.k) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated, coalesce(near_items, 0) AS near_items
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN near USING (doc_id)"""

_OP13 = r"""
WITH RECURSIVE table32 AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t
), runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z\x{C0}-\x{FF}]+')) AS run FROM documents
), counted AS (SELECT id, run, count(*) AS n FROM runs WHERE length(run) >= 5 GROUP BY id, run
), crc AS (
  SELECT run, n, xor(4294967295, list_reduce(list_transform(range(strlen(id || ':' || run)), lambda i: CAST('0x' || substr(hex(id || ':' || run), 2 * i + 1, 2) AS BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295)) AS h FROM counted, table32
), w AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM crc) WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), less AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)
), near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN w b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM less a JOIN w b ON a.rest = b.word
), best AS (SELECT word, count(*) AS n_near, max(near_n) AS top, min(near) FILTER (WHERE near_n = t) AS form FROM (SELECT *, max(near_n) OVER (PARTITION BY word) AS t FROM near) GROUP BY word
), forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 2 * w.n THEN form END AS form, CASE WHEN top >= 2 * w.n THEN top END AS form_n FROM w LEFT JOIN best ON best.word = w.word
), path(word, root) AS (SELECT word, word FROM forms UNION ALL SELECT path.word, forms.form FROM path JOIN forms ON path.root = forms.word WHERE forms.form IS NOT NULL)
SELECT forms.word, form, root, n, n_near, form_n FROM forms JOIN (SELECT path.word, root FROM path JOIN forms ON path.root = forms.word WHERE forms.form IS NULL) p ON p.word = forms.word"""


def queries() -> dict[str, Query]:
    """The operators, in order."""
    return {
        "op1_fingerprints": op1_fingerprints,
        "op2_url_filters": op2_url_filters,
        "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
        "op4_chat_formatting": op4_chat_formatting,
        "op5_toxicity": op5_toxicity,
        "op6_embedding_near_dedup": op6_embedding_near_dedup,
        "op7_line_dedup": op7_line_dedup,
        "op8_packing": op8_packing,
        "op9_mixing": op9_mixing,
        "op10_lm_scoring": op10_lm_scoring,
        "op11_structure_repair": op11_structure_repair,
        "op12_decontamination": op12_decontamination,
        "op13_spelling_variants": op13_spelling_variants,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filters": _OP2, "op3_ngram_jaccard_join": _OP3, "op6_embedding_near_dedup": _OP6, "op4_chat_formatting": _OP4, "op9_mixing": _OP9, "op11_structure_repair": _OP11, "op12_decontamination": _OP12, "op13_spelling_variants": _OP13}
