"""Benchmark decontamination by a positional inverted index, with DataFrame operations only.

1. Benchmark texts become units: runs of up to ``UNIT`` windows of ``WINDOW`` words, equal ones once.
2. The index stores one posting, (document, position, term), for each training token that is a term of the benchmark,
   and one for each document's first place, so that it also holds all documents and their sizes.
3. Terms are counted over all postings.  Every window names its ``LISTS`` rarest places (term and offset) as anchors; windows with
   a term that no document has are left out.
4. Posting lists of the anchors, adjusted by their offsets, are intersected: a unit may stand where two of its anchors say the same start.
5. There the words are compared, so matches are exact whatever the hashes of terms are.

``proximity_matches`` asks the same index for items whose rarest terms stand close together in any order.

Terms meet postings in a broadcast only up to ``FEW`` rows, otherwise in a join that Spark can split where a term is frequent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.storage import written

WINDOW, UNIT, LISTS = 10, 54, 2
#: terms of an item that proximity asks for, and words within which they stand
NEAR_TERMS, NEAR_SPAN = 4, 40
#: rows of terms, anchors or keys that may be broadcast; each is a few numbers
FEW = 1 << 18
#: separates words, after A-Z are lower-cased
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
KEY = ("doc_id", "row")


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _few(df: DataFrame, most: int) -> DataFrame:
    """df, to be broadcast where it is small; it must be cheap to count."""
    return F.broadcast(df) if df.count() <= most else df


def _range(first: Column, last: Column) -> Column:
    """first to last; empty where last is smaller."""
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def pieces(text: Column) -> Column:
    """The words of a text, perhaps with an empty string before and after them."""
    return F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower()), BETWEEN)


def words(text: Column) -> Column:
    return F.filter(pieces(text), lambda w: w != "")


def term(word: Column) -> Column:
    return F.xxhash64(word)


def units(benchmark: DataFrame, window: int = WINDOW, unit: int = UNIT) -> DataFrame:
    """item, unit, words: the units of each item; items without words have none."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)), F.lit(unit))
    cut = items.select("item", F.explode(F.transform(starts, lambda s: F.slice("w", s + 1, unit + window - 1))).alias("words"))
    return cut.select("item", F.xxhash64("words").alias("unit"), "words").distinct()


def build_index(docs: DataFrame, terms: DataFrame, few: int = FEW) -> DataFrame:
    """doc_id, row, n_words, pos, term, asked: postings of the given terms, and each document's first place whatever stands there.

    row is a hash of id and text; rows alike in both are one document to a search.  Positions count from 0 or 1, alike in a document.
    """
    w = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), pieces(F.col("text")).alias("w"))
    blank = (F.element_at("w", 1) == "").cast("long") + ((F.size("w") > 1) & (F.element_at("w", -1) == "")).cast("long")
    each = w.select("doc_id", "row", (F.size("w") - blank).alias("n_words"), F.posexplode("w").alias("pos", "word"))
    known = terms.select("term", F.lit(True).alias("asked"))
    found = each.withColumn("term", term(F.col("word"))).drop("word").join(_few(known, few), "term", "left")
    return found.where(F.col("asked") | (F.col("pos") == 0)).select(*KEY, "n_words", "pos", "term", F.coalesce("asked", F.lit(False)).alias("asked"))


def term_counts(index: DataFrame) -> DataFrame:
    return index.where("asked").groupBy("term").agg(F.count("*").alias("n"))


def anchors(found: DataFrame, counts: DataFrame, window: int = WINDOW, lists: int = LISTS) -> DataFrame:
    """unit, place, term, single: the rarest places of the units' windows; single: a window of one word has no second."""
    one = found.dropDuplicates(["unit"]).select("unit", F.posexplode("words").alias("place", "word"))
    known = one.select("unit", "place", term(F.col("word")).alias("term")).join(counts, "term", "left")
    held = known.groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("place", F.coalesce("n", F.lit(0)).alias("n"), "term"))).alias("p"))

    def rarest(p: Column) -> Column:
        starts = _range(F.lit(1), F.greatest(F.size(p) - window, F.lit(0)) + 1)
        each = F.transform(starts, lambda s: F.array_sort(F.transform(F.slice(p, s, window), lambda x: F.struct(x["n"], x["place"], x["term"]))))
        return F.flatten(F.transform(F.filter(each, lambda x: x[0]["n"] > 0), lambda x: F.transform(F.slice(x, 1, lists), lambda y: F.struct(y["place"], y["term"], (F.size(x) == 1).alias("single")))))

    return held.select("unit", F.explode(F.array_distinct(rarest(F.col("p")))).alias("a")).select("unit", "a.place", "a.term", "a.single")


def candidates(index: DataFrame, wanted: DataFrame, few: int = FEW) -> DataFrame:
    """doc_id, row, unit, start: where two anchors of a unit agree on its start, which may lie before the text."""
    lists = index.where("asked").select(*KEY, "pos", "term").join(_few(wanted, few), "term")
    by = lists.groupBy(*KEY, "unit", (F.col("pos") - F.col("place")).alias("start"))
    return by.agg(F.min("place").alias("a"), F.max("place").alias("b"), F.bool_or("single").alias("single")).where("a != b or single").select(*KEY, "unit", "start")


def phrase_matches(docs: DataFrame, found: DataFrame, places: DataFrame, window: int = WINDOW, few: int = FEW) -> DataFrame:
    """doc_id, row, matches: array<struct<unit,starts>>, n_hit; the windows of units that stand at the places, word by word.

    starts are those of windows in the text, from 0.  Rows alike in doc_id and text are one.
    """
    of_unit = found.dropDuplicates(["unit"]).select("unit", "words")
    held = written(places.join(_few(of_unit, few >> 3), "unit").groupBy(*KEY).agg(F.collect_list(F.struct("unit", "start", "words")).alias("c")), "places").withColumnsRenamed({"doc_id": "d", "row": "r"})
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row") == F.col("r"))
    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")
    keys = held.select("d", "r")
    if held.count() <= few:
        keyed = keyed.join(F.broadcast(keys), same, "left_semi")
    texts = keyed.join(held, same).dropDuplicates(list(KEY))

    def verified(w: Column, c: Column) -> Column:
        n = F.least(F.size(c["words"]), F.lit(window))
        offsets = _range(F.greatest(F.lit(0), -c["start"]), F.least(F.size(c["words"]), F.size(w) - c["start"]) - n)
        return F.struct(c["unit"], n.alias("n"), F.transform(F.filter(offsets, lambda s: F.slice(w, c["start"] + s + 1, n) == F.slice(c["words"], s + 1, n)), lambda s: s + c["start"]).alias("starts"))

    first = lambda w: (w[0] == "").cast("int")
    matched = _let(pieces(F.col("text")), lambda w: _let(first(w), lambda f: F.transform(F.filter(F.transform("c", lambda c: verified(w, c)), lambda m: F.size(m["starts"]) > 0), lambda m: F.struct(m["unit"], m["n"], F.transform(m["starts"], lambda s: s - f).alias("starts")))))
    hit = F.array_distinct(F.flatten(F.transform("matches", lambda m: F.flatten(F.transform(m["starts"], lambda s: F.sequence(s, s + m["n"] - 1))))))
    return texts.select(*KEY, matched.alias("matches")).where(F.size("matches") > 0).withColumn("n_hit", F.size(hit).cast("long"))


def proximity_matches(index: DataFrame, benchmark: DataFrame, counts: DataFrame, terms: int = NEAR_TERMS, span: int = NEAR_SPAN, few: int = FEW) -> DataFrame:
    """doc_id, row, item, first, last: documents with an item's rarest different terms, all of them, within ``span`` words.

    Items of one term are left out, and items with a term among these that no document has.  One row for the first place in the document.
    """
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.array_distinct(words(F.col("text"))).alias("w")).groupBy("w").agg(F.collect_set("item").alias("items"))
    items = items.where(F.size("w") > 1).withColumn("set", F.xxhash64("w"))
    known = items.select("set", F.explode("w").alias("word")).withColumn("term", term(F.col("word"))).join(counts, "term", "left")
    rarest = F.slice(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "term"))), 1, terms)
    asked = known.groupBy("set").agg(rarest.alias("t")).where(F.col("t")[0]["n"] > 0)
    asked = asked.select("set", F.posexplode("t").alias("k", "t"), F.size("t").alias("of")).select("set", "of", F.col("t.term").alias("term"), F.expr("shiftleft(1L, k)").alias("bit"))
    lists = index.where("asked").select(*KEY, "pos", "term").join(_few(asked, few), "term").distinct()  # repeated rows have one document's postings several times
    frame = Window.partitionBy(*KEY, "set").orderBy("pos").rangeBetween(0, span - 1)
    seen = lists.select(*KEY, "set", "of", "pos", F.bit_or("bit").over(frame).alias("bits"), F.max("pos").over(frame).alias("last")).where("bits = shiftleft(1L, of) - 1")
    first = seen.groupBy(*KEY, "set").agg(F.min(F.struct("pos", "last")).alias("at"))
    return first.join(items.select("set", F.explode("items").alias("item")), "set").select(*KEY, "item", F.col("at.pos").alias("first"), F.col("at.last").alias("last"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, unit: int = UNIT, few: int = FEW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, near_items of every row of docs.

    A null or empty text has no words; an item without words occurs nowhere.  Items are told apart by item_id
    (null: an empty one); ids that repeat are one item with several texts.  Repeated documents stay and get the same
    values.  near_items counts the items that ``proximity_matches`` finds, in another order or with gaps as well.
    """
    found = written(units(benchmark, window, unit), "units")
    terms = written(found.select(F.explode("words").alias("word")).select(term(F.col("word")).alias("term")).distinct(), "terms")
    index = written(build_index(docs, terms, few), "postings")
    counts = written(term_counts(index), "counts")
    wanted = written(anchors(found, counts, window), "anchors")
    hits = written(phrase_matches(docs, found, candidates(index, wanted, few), window, few).withColumn("units", F.array_sort(F.array_distinct("matches.unit"))), "hits")
    # documents with the same units have the same items, which are listed once
    sets = hits.select("units").distinct().select("units", F.explode("units").alias("unit")).join(found.select("unit", "item"), "unit")
    sets = sets.groupBy("units").agg(F.array_sort(F.collect_set("item")).alias("items")).select("units", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    named = hits.join(sets, "units").select(*KEY, "n_hit", "n_items", "items_sha256")
    near = proximity_matches(index, benchmark, counts, few=few).groupBy(*KEY).agg(F.count_distinct("item").alias("near_items"))
    of = lambda df, k: df.withColumnsRenamed({c: f"{k}_{c}" for c in KEY})
    same = lambda k: F.col("doc_id").eqNullSafe(F.col(f"{k}_doc_id")) & (F.col("row") == F.col(f"{k}_row"))
    out = index.where("pos = 0").select(*KEY, "n_words").join(of(named, "h"), same("h"), "left").join(of(near, "p"), same("p"), "left")
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", "n_words", none("n_hit"), none("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"), none("near_items"))
