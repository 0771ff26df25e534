import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quire.llm import spelling as sp

UP = str.maketrans(sp.UPPER, sp.UPPER.lower())


def read(docs, of=97):
    """Counts of the words in (doc_id, text) rows, some with a letter lost."""
    out = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UP)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % of == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= sp.LEAST_LENGTH and n >= sp.LEAST_COUNT}


def is_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def brute(counts, ratio=sp.RATIO):
    forms, near_n = {}, {}
    for w, n in counts.items():
        near = [x for x in counts if is_near(w, x)]
        near_n[w] = len(near)
        best = min(near, key=lambda x: (-counts[x], x), default=None)
        forms[w] = best if best is not None and counts[best] >= ratio * n else None
    out = []
    for w, n in counts.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        out.append((w, forms[w], root, n, near_n[w], counts.get(forms[w])))
    return sorted(out)


def families(rng, stems=25):
    """Words with edits of edits, so that forms chain, letters repeat and other words have the same letters."""
    letters = "abcéñßxÿ"
    words = Counter()
    for _ in range(stems):
        w = "".join(rng.choice(letters) for _ in range(rng.randrange(4, 9)))
        n = 400
        for _ in range(10):
            words[w] += max(1, n)
            words["".join(rng.sample(w, len(w)))] += rng.randrange(1, 5)
            k = rng.randrange(len(w) + 1)
            w = rng.choice([w[:k] + rng.choice(letters) + w[k:], w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k + 1 :]]) or "a"
            n = rng.choice([n // 2, n // 3, n])
    words.update({"aaaaa": 9, "aaaaaa": 30, "aaaaaaa": 3, "aabaa": 4, "x" * 3000: 3, "x" * 2999 + "é": 7})
    return words


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_forms_and_roots_against_brute_force(spark, seed):
    counts = {w: n for w, n in families(random.Random(seed)).items() if len(w) >= 2}
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(4).withColumn("key", F.lit(1)).withColumn("letter", F.lit("a"))
    got = sorted(tuple(r) for r in sp.variants(df).collect())
    assert got == brute(counts)
    assert sum(r[2] != (r[1] or r[0]) for r in got) > 5


def test_whole_texts(spark, messy_rows):
    """Words of all texts, with letters lost in many runs."""
    rng = random.Random(8)
    words = [w for w in families(rng, 8) if len(w) < 50]
    docs = [(r[0], r[1]) for r in messy_rows]
    docs += [(k, ", ".join(rng.choice([w, w.upper(), w.capitalize()]) if w.isascii() else w for w in rng.choices(words, k=60)) + ("1" if k % 2 else "")) for k in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5).withColumn("word", F.lit(7)).withColumn("n", F.lit("x"))
    for of in (97, 3):
        found = sp.vocabulary(df, lambda i, r, of=of: sp.one_letter_lost(i, r, of))
        assert {r.word: r.n for r in found.collect()} == read(docs, of)
        assert sorted(tuple(r) for r in sp.variants(found).collect()) == brute(read(docs, of))


def test_pairs_come_once(spark):
    words = ["abcdef", "abcdeg", "abcde", "bcdef", "abcdeff", "aabcdef", "fedcba", "aa", "ab", "a" * 9, "a" * 8, "acbdef"]
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    pairs = [(r.word, r.near) for r in sp.near_pairs(df).collect()]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {(a, b) for a in words for b in words if is_near(a, b)}


def test_anagram_keys(spark):
    df = spark.createDataFrame([("listen",), ("silent",), ("enlist",), ("tinsel",), ("listens",), ("",)], "w string")
    keys = {r.w: r.k for r in df.select("w", sp.anagram_key(F.filter(F.split("w", ""), lambda x: x != "")).alias("k")).collect()}
    assert len({keys[w] for w in ("listen", "silent", "enlist", "tinsel")}) == 1
    assert keys["listens"] - keys["listen"] == ord("s") ** sp.POWER and keys[""] == 0


def test_empty(spark, empty):
    assert sp.variants(sp.vocabulary(empty, sp.one_letter_lost)).count() == 0
    few = spark.createDataFrame([(1, "hello hello hello"), (2, None)], "doc_id long, text string")
    assert [tuple(r) for r in sp.variants(sp.vocabulary(few)).collect()] == [("hello", None, "hello", 3, 0, None)]
