import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quire.functions import edits
from quire.plans import evaluation

VERSE = "En un lugar de la Mancha, de cuyo nombre no quiero acordarme, no ha mucho tiempo que vivia un hidalgo, the thin one. "


def read(text):
    return text.translate(str.maketrans("vjVJ", "uiUI")).replace("th", "tn").replace(", ", ",")


def pairs():
    rng = random.Random(4)
    for k in range(400):
        letters = "ab" if k % 2 else "abcdé \U0001f600"
        a = "".join(rng.choice(letters) for _ in range(rng.randint(0, 90)))
        if k % 3:
            yield a, "".join("" if rng.random() < 0.08 else rng.choice(letters) if rng.random() < 0.1 else c for c in a)
        else:
            yield a, "".join(rng.choice(letters) for _ in range(rng.randint(0, 90)))
    yield VERSE * 3, read(VERSE * 3)


def test_gaps_bounds_and_grams():
    for a, b in pairs():
        i = j = 0
        for at, to, below, end in edits.gaps(a, b):
            assert a[i:at] == b[j:below]
            i, j = to, end
        assert a[i:] == b[j:]
        lower, upper = edits.bounded_distance(a, b)
        want = edits.sequence_distance(a, b)
        assert lower <= want <= upper and edits.exact_distance(a, b) == want
        assert edits.word_distance(a, b) == edits.sequence_distance(a.split(), b.split())
        found = edits.gram_matches(["xyz", a, b, ""], [b, b, a, a])
        for (x, y), row in zip((("xyz", b), (a, b), (b, a), ("", a)), found.tolist(), strict=True):
            grams = [[Counter(t[k : k + n] for k in range(len(t) - n + 1)) for t in (x, y)] for n in range(1, 7)]
            assert row == [v for r, h in grams for v in ((r & h).total(), r.total(), h.total())]


def test_what_a_recogniser_confuses_needs_no_table(monkeypatch):
    """Neither characters nor words of a long line are compared in a table of all of both."""
    sizes = []
    whole = edits.sequence_distance
    monkeypatch.setattr(edits, "sequence_distance", lambda a, b: (sizes.append(len(a) * len(b)), whole(a, b))[1])
    a = VERSE * 300
    assert edits.exact_distance(a, read(a)) == 300 * (3 + 2 + 2) and edits.word_distance(a, read(a)) > 0
    assert max(sizes, default=0) < 1000


def test_only_grams_that_a_difference_touches_are_sorted():
    a = VERSE * 300
    left, right, blocks = edits._runs([a], [read(a)])
    for text, runs in ((a, left), (read(a), right)):
        keys = [k for k, _ in edits._left(*edits._matched([text], runs, blocks), 6)]
        assert sum(map(len, keys)) < 6 * len(text) / 3


def test_python_takes_more_for_white_space_than_unicode(spark):
    rows = [("a\x1cb c", "a\x1cb d"), ("a\x85b", "a b"), ("a　 b", "ab"), (None, "a"), ("", "a b")]
    df = spark.createDataFrame(rows, "ref string, hyp string")
    assert [r.e for r in df.select(edits.word_edits(F.col("ref"), F.col("hyp")).alias("e")).collect()] == [1, 0, 2, None, 2]


def test_a_slice_compares_no_more_than_its_lines(spark, sf_dir):
    found = evaluation.slice_30_45(spark, sf_dir)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and found.count() == 15
    assert [r.pos for r in found.orderBy("pos").collect()] == list(range(31, 46))


def test_joined_pages_are_made_once(spark, sf_dir):
    found = evaluation.cer_joined_corpus(spark, sf_dir)
    assert "CartesianProduct" not in (plan := found._jdf.queryExecution().executedPlan().toString()) and "BroadcastNestedLoopJoin" not in plan
    assert found.first().cer == pytest.approx(found.first().edits / found.first().chars, abs=1e-6)


def test_a_wrong_step_is_taken_back():
    """Characters that recur at once lead astray; what is near an odd gap is compared again, not the whole text."""
    a = VERSE + "de, the the ing, the thoor e. " + VERSE
    assert edits.bounded_distance(a, read(a)) == (edits.sequence_distance(a, read(a)),) * 2
