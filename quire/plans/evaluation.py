"""Recognition quality: error rates, chrF, before and after."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.functions import edits, text
from quire.operators import metrics, quality
from quire.plans.lines import DISTANCE, EDITS, GRAMS, LINES, PIECES, lines, pieces, table

F2 = "CASE WHEN sum(m) = 0 THEN 0.0 ELSE 5.0 * (sum(m)::DOUBLE / sum(h)) * (sum(m)::DOUBLE / sum(r)) / (4.0 * (sum(m)::DOUBLE / sum(h)) + sum(m)::DOUBLE / sum(r)) END"
CHRF_TAIL = "SELECT {k} round(sum(f) / 6, 6) AS chrf FROM (SELECT {k} n, " + F2 + " AS f FROM gs GROUP BY {k} n) {g}"
RATES = "round(sum(c_edits)::DOUBLE / sum(c_len), 6) AS cer, round(sum(w_edits)::DOUBLE / sum(w_len), 6) AS wer, CAST(sum(c_edits) AS BIGINT) AS cer_edits, CAST(sum(c_len) AS BIGINT) AS cer_chars, CAST(sum(w_edits) AS BIGINT) AS wer_edits, CAST(sum(w_len) AS BIGINT) AS wer_words"
QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def _rounded(df, *columns, digits: int = 6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("cer_wer_chrf_by_source", f"WITH {PIECES}, {EDITS}, {GRAMS.replace('line_no', 'line_no, piece').format('h')}, c AS ({CHRF_TAIL.format(k='source,', g='GROUP BY source')}) SELECT e.source, count(*) AS num_samples, {RATES}, any_value(chrf) AS chrf FROM e JOIN c ON e.source = c.source GROUP BY e.source")
def cer_wer_chrf_by_source(spark, sf_dir):
    held = metrics.with_edits(pieces(spark, sf_dir)).withColumn("grams", edits.gram_counts(F.col("ref"), F.col("hyp")))
    out = held.groupBy("source").agg(*metrics.edit_sums(), *metrics.gram_sums())
    out = out.withColumns({"cer": F.col("cer_edits") / F.col("cer_chars"), "wer": F.col("wer_edits") / F.col("wer_words"), "chrf": metrics.chrf()})
    return _rounded(out, "cer", "wer", "chrf").select("source", "num_samples", "cer", "wer", "cer_edits", "cer_chars", "wer_edits", "wer_words", "chrf")


@query("cer_overall", f"WITH {PIECES}, {EDITS} SELECT count(*) AS num_samples, {RATES} FROM e")
def cer_overall(spark, sf_dir):
    return _rounded(metrics.rates(metrics.with_edits(pieces(spark, sf_dir)), []), "cer", "wer")


CER = "count(*) AS num_samples, CAST(sum(levenshtein(ref, hyp)) AS BIGINT) AS cer_edits, CAST(sum(greatest(1, length(ref))) AS BIGINT) AS cer_chars"


@query("cer_by_source", f"WITH {LINES}, s AS (SELECT source, {CER} FROM h GROUP BY source) SELECT source, num_samples, round(cer_edits::DOUBLE / cer_chars, 6) AS cer, cer_edits, cer_chars FROM s")
def cer_by_source(spark, sf_dir):
    """CER of whole lines."""
    counted = lines(spark, sf_dir).select("source", edits.char_edits(F.col("ref"), F.col("hyp")).alias("e"), edits.char_length(F.col("ref")).alias("n"))
    out = counted.groupBy("source").agg(F.count("*").alias("num_samples"), F.sum("e").cast("long").alias("cer_edits"), F.sum("n").cast("long").alias("cer_chars"))
    return out.select("source", "num_samples", F.round(F.col("cer_edits") / F.col("cer_chars"), 6).alias("cer"), "cer_edits", "cer_chars")


@query("cer_corpus", f"WITH {LINES} SELECT CAST(sum(levenshtein(ref, hyp)) AS BIGINT) AS edits, CAST(sum(length(ref)) AS BIGINT) AS chars, round(sum(levenshtein(ref, hyp))::DOUBLE / sum(length(ref)), 6) AS cer FROM h")
def cer_corpus(spark, sf_dir):
    """CER of a list of whole lines, lengths as they are."""
    return metrics.list_rate(lines(spark, sf_dir)).withColumn("cer", F.round("cer", 6))


@query("wer_by_source", f"WITH {PIECES}, {EDITS} SELECT source, round(sum(w_edits)::DOUBLE / sum(w_len), 6) AS wer, CAST(sum(w_edits) AS BIGINT) AS wer_edits, CAST(sum(w_len) AS BIGINT) AS wer_words FROM e GROUP BY source")
def wer_by_source(spark, sf_dir):
    out = metrics.rates(metrics.with_edits(pieces(spark, sf_dir)), ["source"])
    return _rounded(out, "wer").select("source", "wer", "wer_edits", "wer_words")


@query("wer_whole_lines")
def wer_whole_lines(spark, sf_dir):
    """WER of whole lines; tests hold the expression to a plain programme, as SQL has no distance of words."""
    out = metrics.rates(metrics.with_edits(lines(spark, sf_dir)), ["source"])
    return _rounded(out, "wer").select("source", "wer", "wer_edits", "wer_words")


@query("chrf_corpus", f"WITH {LINES}, {GRAMS.format('h')} {CHRF_TAIL.format(k='', g='')}")
def chrf_corpus(spark, sf_dir):
    return _rounded(metrics.corpus_chrf(lines(spark, sf_dir), []), "chrf")


@query("chrf_by_source", f"WITH {LINES}, {GRAMS.format('h')} {CHRF_TAIL.format(k='source,', g='GROUP BY source')}")
def chrf_by_source(spark, sf_dir):
    return _rounded(metrics.corpus_chrf(lines(spark, sf_dir), ["source"]), "chrf")


BARE = r"bare AS (SELECT doc_id, source, line_no, regexp_replace(ref, '\s+', '', 'g') AS ref, regexp_replace(hyp, '\s+', '', 'g') AS hyp FROM h)"
MEANS = "coalesce(avg(m::DOUBLE / h) FILTER (WHERE r > 0 AND h > 0), 0) AS p, coalesce(avg(m::DOUBLE / r) FILTER (WHERE r > 0 AND h > 0), 0) AS q"


@query("chrf_by_line", f"WITH {LINES}, {BARE}, {GRAMS.format('bare')}, f AS (SELECT doc_id, line_no, {MEANS} FROM gs GROUP BY ALL) SELECT doc_id, line_no, round(CASE WHEN p = 0 AND q = 0 THEN 0 ELSE 10.0 * p * q / (9.0 * p + q) END, 6) AS chrf FROM f")
def chrf_by_line(spark, sf_dir):
    return _rounded(metrics.sentence_chrf(lines(spark, sf_dir), ["doc_id", "line_no"]), "chrf")


@query("chrf_effective_orders", f"WITH {LINES}, {BARE}, {GRAMS.format('bare')}, t AS (SELECT source, n, sum(m) AS m, sum(r) AS r, sum(h) AS h FROM gs GROUP BY ALL), f AS (SELECT source, {MEANS} FROM t GROUP BY source) SELECT source, round(CASE WHEN p = 0 AND q = 0 THEN 0 ELSE 100 * 5.0 * p * q / (4.0 * p + q) END, 4) AS chrf FROM f")
def chrf_effective_orders(spark, sf_dir):
    counted = lines(spark, sf_dir).select("source", edits.gram_counts(F.col("ref"), F.col("hyp"), spaces=False).alias("grams"))
    return counted.groupBy("source").agg(*metrics.gram_sums()).select("source", F.round(metrics.chrf_effective(), 4).alias("chrf"))


@query("ngram_intersection", f"WITH {LINES}, {GRAMS.format('h')} SELECT n, CAST(sum(m) AS BIGINT) AS matches, CAST(sum(r) AS BIGINT) AS ref_grams, CAST(sum(h) AS BIGINT) AS hyp_grams FROM gs GROUP BY n")
def ngram_intersection(spark, sf_dir):
    counted = lines(spark, sf_dir).select(edits.gram_counts(F.col("ref"), F.col("hyp")).alias("grams")).agg(*metrics.gram_sums())
    rows = F.explode(F.array(*[F.struct(F.lit(n + 1).cast("long").alias("n"), F.col(f"_g{3 * n}").alias("matches"), F.col(f"_g{3 * n + 1}").alias("ref_grams"), F.col(f"_g{3 * n + 2}").alias("hyp_grams")) for n in range(6)]))
    return counted.select(rows.alias("r")).select("r.*")


@query("metrics_rollup", f"WITH {PIECES}, {EDITS} SELECT lang, source, count(*) AS num_samples, {RATES} FROM e GROUP BY GROUPING SETS ((), (lang), (lang, source))")
def metrics_rollup(spark, sf_dir):
    out = metrics.with_edits(pieces(spark, sf_dir)).rollup("lang", "source").agg(*metrics.edit_sums())
    return out.select("lang", "source", "num_samples", F.round(F.col("cer_edits") / F.col("cer_chars"), 6).alias("cer"), F.round(F.col("wer_edits") / F.col("wer_words"), 6).alias("wer"), "cer_edits", "cer_chars", "wer_edits", "wer_words")


@query("cer_joined_corpus", f"WITH {LINES}, o AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1) // 20 AS page FROM h), j AS (SELECT doc_id, page, string_agg(ref, chr(10) ORDER BY line_no) AS r, string_agg(hyp, chr(10) ORDER BY line_no) AS p FROM o GROUP BY ALL) SELECT count(*) AS pages, CAST(sum(levenshtein(r, p)) AS BIGINT) AS edits, CAST(sum(length(r)) AS BIGINT) AS chars, round(sum(levenshtein(r, p))::DOUBLE / sum(length(r)), 6) AS cer FROM j")
def cer_joined_corpus(spark, sf_dir):
    """CER of pages of 20 whole lines joined by newlines, where an edit may cross lines."""
    joined = metrics.joined(lines(spark, sf_dir), ["doc_id"], [F.col("line_no")], 20)
    return metrics.list_rate(joined, total="pages").select("pages", "edits", "chars", F.round("cer", 6).alias("cer"))


@query("near_copy_cer", f"WITH {LINES}, k AS (SELECT doc_id, string_split(text, chr(10))[1] AS k FROM documents), f AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS first_id FROM k), c AS (SELECT f.doc_id, f.first_id, h.line_no, h.ref FROM f JOIN h ON f.doc_id = h.doc_id WHERE f.doc_id <> f.first_id), p AS (SELECT c.doc_id, c.first_id, c.ref, o.ref AS o, list_distinct(string_split(coalesce(o.ref, '') || c.ref, '')) AS k FROM c LEFT JOIN h o ON o.doc_id = c.first_id AND o.line_no = c.line_no) SELECT doc_id, first_id, CAST(sum(CASE WHEN o IS NULL THEN length(ref) WHEN o = ref THEN 0 ELSE {DISTANCE.format('o', 'ref')} END) AS BIGINT) AS edits, CAST(sum(length(ref)) AS BIGINT) AS chars FROM p GROUP BY ALL")
def near_copy_cer(spark, sf_dir):
    """Edits of documents against the first that begins with the same line, whole line by whole line."""
    key = table(spark, sf_dir, "documents").select("doc_id", F.xxhash64(F.split("text", "\n")[0]).alias("k"))
    first = key.groupBy("k").agg(F.min("doc_id").alias("first_id"))
    pairs = key.join(first, "k").where("doc_id != first_id").select("doc_id", "first_id")
    every = lines(spark, sf_dir).select("doc_id", "line_no", "ref")
    copies = pairs.join(every, "doc_id")
    origin = every.join(pairs.select(F.col("first_id").alias("doc_id")).distinct(), "doc_id", "left_semi").select(F.col("doc_id").alias("first_id"), "line_no", F.col("ref").alias("o"))
    edit = F.when(F.col("o").isNull(), F.length("ref")).otherwise(edits.char_edits(F.col("o"), F.col("ref")))
    return copies.join(origin, ["first_id", "line_no"], "left").groupBy("doc_id", "first_id").agg(F.sum(edit).cast("long").alias("edits"), F.sum(F.length("ref")).cast("long").alias("chars"))


TWO = "b AS (SELECT doc_id, line_no, source, length(ref) AS n, CAST(levenshtein(ref, hyp) AS BIGINT) AS eb, CAST(levenshtein(ref, hyp2) AS BIGINT) AS ea, eb::DOUBLE / greatest(1, length(ref)) AS before, ea::DOUBLE / greatest(1, length(ref)) AS after FROM h)"


def before_after(spark, sf_dir):
    return _compared(lines(spark, sf_dir))


def _compared(held, *more):
    n = edits.char_length(F.col("ref"))
    out = held.select("doc_id", "source", "line_no", *more, edits.char_edits(F.col("ref"), F.col("hyp")).cast("long").alias("eb"), edits.char_edits(F.col("ref"), F.col("hyp2")).cast("long").alias("ea"), n.cast("long").alias("n"))
    return out.withColumns({"before": F.col("eb") / F.col("n"), "after": F.col("ea") / F.col("n")})


@query("improved_same_worse", f"WITH {LINES}, {TWO}, s AS (SELECT count(*) AS n, count(*) FILTER (WHERE after < before) AS improved, count(*) FILTER (WHERE after = before) AS same, count(*) FILTER (WHERE after > before) AS worse FROM b) SELECT n, improved, same, worse, round(100.0::DOUBLE * improved / n, 6) AS improved_pct, round(100.0::DOUBLE * same / n, 6) AS same_pct, round(100.0::DOUBLE * worse / n, 6) AS worse_pct FROM s")
def improved_same_worse(spark, sf_dir):
    return _rounded(quality.changes(before_after(spark, sf_dir), "before", "after"), "improved_pct", "same_pct", "worse_pct")


@query("metric_histogram", f"WITH {LINES}, {TWO} SELECT CAST(least(floor(least(greatest(before, 0.0::DOUBLE), 0.5::DOUBLE) / (0.5::DOUBLE / 40)) + 1, 40) AS INTEGER) AS bin, count(*) AS n FROM b GROUP BY 1")
def metric_histogram(spark, sf_dir):
    return quality.histogram(before_after(spark, sf_dir), "before", 0.0, 0.5, 40)


@query("metric_median", f"WITH {LINES}, {TWO} SELECT source, round(median(before), 6) AS median_before, round(median(after), 6) AS median_after, round(avg(before), 6) AS mean_before, round(max(before), 6) AS max_before, round(min(after), 6) AS min_after, round(stddev_pop(before), 6) AS std_before FROM b GROUP BY source")
def metric_median(spark, sf_dir):
    out = before_after(spark, sf_dir).groupBy("source").agg(F.median("before").alias("median_before"), F.median("after").alias("median_after"), F.avg("before").alias("mean_before"), F.max("before").alias("max_before"), F.min("after").alias("min_after"), F.stddev_pop("before").alias("std_before"))
    return _rounded(out, *out.columns[1:])


@query("relative_gain", f"WITH {LINES}, {TWO}, s AS (SELECT sum(eb)::DOUBLE / sum(n) AS cb, sum(ea)::DOUBLE / sum(n) AS ca FROM b) SELECT round(cb, 6) AS cer_before, round(ca, 6) AS cer_after, round(ca - cb, 6) AS delta, round(1 - ca / cb, 6) AS relative_gain FROM s")
def relative_gain(spark, sf_dir):
    """The corpus rates before and after, with differences that are null where one is missing."""
    both = before_after(spark, sf_dir).agg((F.sum("eb") / F.sum("n")).alias("cb"), (F.sum("ea") / F.sum("n")).alias("ca"))
    return both.select(F.round("cb", 6).alias("cer_before"), F.round("ca", 6).alias("cer_after"), F.round(F.col("ca") - F.col("cb"), 6).alias("delta"), F.round(1 - F.try_divide("ca", "cb"), 6).alias("relative_gain"))


@query("highlight_low", f"WITH {LINES}, {TWO} SELECT source, count(*) FILTER (WHERE coalesce(before < 0.1, false) OR coalesce(after < 0.1, false)) AS low, count(*) AS n FROM b GROUP BY source")
def highlight_low(spark, sf_dir):
    low = F.coalesce(F.col("before") < 0.1, F.lit(False)) | F.coalesce(F.col("after") < 0.1, F.lit(False))
    return before_after(spark, sf_dir).groupBy("source").agg(F.count_if(low).alias("low"), F.count("*").alias("n"))


@query("slice_30_45", f"WITH {LINES}, {TWO}, r AS (SELECT *, row_number() OVER (ORDER BY doc_id, line_no) AS pos FROM b) SELECT doc_id, line_no, pos, round(before, 6) AS before FROM r WHERE pos BETWEEN 31 AND 45")
def slice_30_45(spark, sf_dir):
    """Lines up to the last that is asked for are kept of each task's; these few alone are numbered and compared."""
    order = [F.asc_nulls_last("doc_id"), F.asc_nulls_last("line_no")]
    first = lines(spark, sf_dir).orderBy(*order).limit(45)
    placed = first.withColumn("pos", F.row_number().over(Window.orderBy(*order)).cast("long")).where("pos > 30")
    return _rounded(_compared(placed, "pos"), "before").select("doc_id", "line_no", "pos", "before")


@query("tail_5", f"WITH {LINES}, {TWO} SELECT doc_id, line_no, round(after, 6) AS after FROM b ORDER BY doc_id DESC, line_no DESC LIMIT 5")
def tail_5(spark, sf_dir):
    return _rounded(before_after(spark, sf_dir).select("doc_id", "line_no", "after").orderBy(F.desc("doc_id"), F.desc("line_no")).limit(5), "after")


FROM_, TO = text.ALIKE


@query("normalised_cer", f"WITH {LINES}, z AS (SELECT source, regexp_replace(translate(ref, '{FROM_}', '{TO}'), '-+$', '') AS r, regexp_replace(translate(hyp, '{FROM_}', '{TO}'), '-+$', '') AS p FROM h) SELECT source, CAST(sum(levenshtein(r, p)) AS BIGINT) AS edits, CAST(sum(greatest(1, length(r))) AS BIGINT) AS chars FROM z GROUP BY source")
def normalised_cer(spark, sf_dir):
    """CER of whole lines with interchangeable spellings made equal."""
    rows = lines(spark, sf_dir).select("source", text.evaluation_form(F.col("ref")).alias("r"), text.evaluation_form(F.col("hyp")).alias("p"))
    return rows.groupBy("source").agg(F.sum(edits.char_edits(F.col("r"), F.col("p"))).cast("long").alias("edits"), F.sum(edits.char_length(F.col("r"))).cast("long").alias("chars"))


ALONE = r"regexp_replace({0}, '(^|[^\p{{L}}\p{{N}}_])q([^\p{{L}}\p{{N}}_]|$)', '\1que\2', 'g')"


@query("rule_correction", f"WITH {LINES}, r AS (SELECT lang, ref, {ALONE.format(ALONE.format("translate(ref, 'çÇ', 'zZ')"))} AS fixed FROM h) SELECT lang, count(*) AS n, count(*) FILTER (WHERE fixed <> ref) AS changed, CAST(sum(length(fixed)) AS BIGINT) AS chars FROM r GROUP BY lang")
def rule_correction(spark, sf_dir):
    fixed = text.corrected(F.col("ref"))
    return lines(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n"), F.count_if(fixed != F.col("ref")).alias("changed"), F.sum(F.length(fixed)).cast("long").alias("chars"))
