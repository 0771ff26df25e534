"""Spelling variants by anagram hashing.

A word's key is the sum of a power of each of its letters, so words of the same letters have one key.  An edit changes the
key by one letter's value: an addition or removal by that value, an exchange by the difference of two.  Both are equi-joins
on keys less a letter: a word less a letter has the key of the shorter word, two words less the letters
that are exchanged have one key.  What stands before or behind the edit is at least half of what both words share, so that half is part
of the key: groups of equal keys stay small however many words have the same letters.  The order of letters is verified by
edit distance.  Expressions and joins only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.storage import drop, written

LEAST_LENGTH, LEAST_COUNT, RATIO = 5, 3, 2
POWER = 5
#: sums of powers are kept modulo this prime, so that words of millions of letters do not overflow
PRIME = (1 << 61) - 1
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: separates runs of letters, after A-Z are lower-cased
BETWEEN = "[^a-zÀ-ÿ]+"


def vocabulary(docs: DataFrame, damage: Callable[[Column, Column], Column] | None = None, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: the runs of letters in all texts, A-Z lower-cased, of at least that length and count.

    damage(doc_id, run) gives the word that is read for a run of ``least_length`` letters or more; it is never longer than the run.
    """
    text = F.translate("text", UPPER, UPPER.lower())
    runs = docs.where("text is not null").select("doc_id", F.explode(F.split(text, BETWEEN)).alias("word")).where(F.length("word") >= least_length)
    if damage is not None:
        runs = runs.withColumn("word", damage(F.col("doc_id"), F.col("word"))).where(F.length("word") >= least_length)
    return runs.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def one_letter_lost(doc_id: Column, run: Column, of: int = 97) -> Column:
    """The run without one letter where the crc32 of ``<doc_id>:<run>`` is divisible by ``of``; a null id is empty there."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    return F.when(h % of == 0, F.overlay(run, F.lit(""), (h % F.length(run) + 1).cast("int"), F.lit(1))).otherwise(run)


def letter_value(letter: Column) -> Column:
    code = F.ascii(letter).cast("long")
    out = code
    for _ in range(POWER - 1):
        out = out * code
    return out


def anagram_key(letters: Column) -> Column:
    """Of an array of letters."""
    return F.aggregate(letters, F.lit(0).cast("long"), lambda a, x: F.pmod(a + letter_value(x), F.lit(PRIME)))


def _keyed(words: DataFrame) -> DataFrame:
    """key, letter, side, word, n: the word as it is (letter: null) and less each letter of its second half (side 0: the first half is in the key), or of its first half (side 1)."""
    size = F.length("word")
    held = words.select("word", "n", size.alias("size"), F.filter(F.split("word", ""), lambda x: x != "").alias("letters")).withColumn("whole", anagram_key(F.col("letters")))

    def entry(side: int, kept: Column, value: Column, letter: Column) -> Column:
        half = F.left("word", kept) if side == 0 else F.right("word", kept)
        return F.struct(F.xxhash64(F.lit(side), value, half).alias("key"), letter.alias("letter"), F.lit(side).alias("side"))

    kept_whole, kept_less = F.expr("(size + 1) div 2").cast("int"), F.expr("size div 2").cast("int")
    less = lambda c: F.pmod(F.col("whole") - letter_value(c), F.lit(PRIME))
    parts = [
        F.array(*[entry(side, kept_whole, F.col("whole"), F.lit(None).cast("string")) for side in (0, 1)]),
        F.transform(F.array_distinct(F.slice("letters", kept_less + 1, F.col("size"))), lambda c: entry(0, kept_less, less(c), c)),
        F.transform(F.array_distinct(F.slice("letters", 1, F.col("size") - kept_less)), lambda c: entry(1, kept_less, less(c), c)),
    ]
    return held.select("word", "n", F.explode(F.concat(*parts)).alias("e")).select("e.key", "e.letter", "e.side", "word", "n")


def near_pairs(words: DataFrame) -> DataFrame:
    """word, near, near_n: all pairs, both ways, of words of two letters or more that differ by one inserted, deleted or replaced code point."""
    keyed = _keyed(words).repartition("key")
    longer = keyed.where("letter is not null")
    other = keyed.select(F.col("key").alias("key2"), F.col("letter").alias("letter2"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    met = longer.join(other, (F.col("key") == F.col("key2")) & (F.col("letter2").isNull() | ((F.col("letter") != F.col("letter2")) & (F.col("word") < F.col("near")))))
    kept = F.expr("length(word) div 2").cast("int")
    once = (F.col("side") == 0) | (F.left("word", kept) != F.left("near", kept))  # what both sides find counts at side 0
    found = met.where(once & (F.levenshtein("word", "near", 1) == 1))
    both = F.explode(F.array(F.struct("word", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n"))))
    return found.select(both.alias("p")).select("p.*")


def followed(forms: DataFrame) -> DataFrame:
    """word, root: from each word, its forms to the last; forms: word, form, without circles.  Steps double each round."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        moved = written(now.join(ahead, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")), "roots")
        drop(now)
        now = moved.select("word", "root")
        if not moved.where("moved").limit(1).count():
            return now


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word; words: word (different ones), n.

    A word's form is its near word of largest n (ties: smallest in code-point order) if that is ``ratio`` times the word's own n,
    else null; its root is the last of its forms, or itself.
    """
    words = written(words, "words")
    pairs = near_pairs(words).repartition("word").dropDuplicates(["word", "near"])
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("best"))
    held = words.join(best.withColumnRenamed("word", "_w"), F.col("word") == F.col("_w"), "left")
    fits = -F.col("best.n") >= ratio * F.col("n")
    held = written(held.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.n")).alias("form_n")), "forms")
    roots = followed(held.where("form is not null").select("word", "form")).withColumnRenamed("word", "_w")
    return held.join(roots, F.col("word") == F.col("_w"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
