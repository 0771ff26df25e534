import pytest
from pyspark.sql import functions as F

from quire.llm import mixing
from tests.llm.test_fingerprints import words


def waterfill(sizes):
    """Targets by repeated sharing of what is above twice a source's size."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        rest = total - sum(fixed.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if share[s] > 2 * sizes[s]]
        if not above:
            return fixed | share
        fixed |= {s: 2.0 * sizes[s] for s in above}


def test_targets_and_taken_words(messy, messy_rows):
    rows = mixing.mix(messy, keep=("text",)).collect()
    assert len(rows) == len(messy_rows)
    sizes = {}
    for r in messy_rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(words(r[1]))
    want, got = waterfill(sizes), {}
    for r in rows:
        assert r["size"] == len(words(r.text)) and r.source_size == sizes[r.source] and 0 <= r.taken <= 2 * r["size"]
        assert r.target == pytest.approx(want[r.source])
        got[r.source] = got.get(r.source, 0) + r.taken
    for s, n in got.items():
        assert abs(n - want[s]) <= 1
    again = mixing.mix(messy.repartition(3), keep=("text",)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_epochs_come_before_parts_and_weights_matter(spark):
    docs = spark.createDataFrame([(i, "w " * 50, s) for s, n in (("a", 4), ("b", 400)) for i in range(1000 * (s == "b"), 1000 * (s == "b") + n)], "doc_id long, text string, source string")
    quality = spark.createDataFrame([(1000 + i, 8.0 if i % 2 else 0.1) for i in range(400)], "doc_id long, weight double")
    rows = mixing.mix(docs, quality).collect()
    assert all(r.taken == 100 for r in rows if r.source == "a")  # two epochs, as far as it goes
    b = [r for r in rows if r.source == "b"]
    assert all(r.taken >= 50 for r in b)
    more = [r.doc_id % 2 for r in b if r.taken > 50]
    assert sum(more) / len(more) > 0.8


def test_first_words_and_edges(spark, empty):
    row = spark.createDataFrame([(" a  b\tc ",)], "t string").select(mixing.first_words(F.col("t"), F.lit(2)).alias("a"), mixing.first_words(F.col("t"), F.lit(0)).alias("b"), mixing.word_count(F.col("t")).alias("n")).first()
    assert tuple(row) == (" a  b", "", 3)
    assert mixing.mix(empty).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, " ", "x")], "doc_id long, text string, source string")
    assert {(r.doc_id, r["size"], r.target, r.taken) for r in mixing.mix(blank).collect()} == {(1, 0, 0.0, 0), (2, 0, 0.0, 0)}


def test_labels(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (3, None)], "doc_id long, quality int")
    assert {(r.doc_id, r.weight) for r in mixing.quality_weights(labels).collect()} == {(1, 2.0), (2, 0.5)}
