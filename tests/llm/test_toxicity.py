import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import toxicity as tx
from tests.llm.conftest import wordy

BAD = ["zorgon", "blithwick", "quaxley", "vumpter", "drondle"]


def corpus(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words, bad = wordy(rng, rng.randint(30, 120)).split(), i % 5 == 0
        for _ in range(6 if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(BAD))
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_learns_what_toxic_texts_have_of_their_own(spark):
    rows = corpus(500, 3)
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4)
    model = tx.train(df.drop("toxic").withColumn("_id", F.lit(1)), df.select("doc_id", "toxic"))
    out = {r.doc_id: r for r in tx.score_documents(df, model).withColumn("held", tx.held_out(F.col("doc_id"))).collect()}
    held = [(out[i].predicted, y) for i, _, y in rows if out[i].held]
    assert sum(p == y for p, y in held) / len(held) > 0.95
    assert {i for i in out if out[i].held} == {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    assert any(w.encode() in model.toxic for w in BAD) and not any(w.encode() in model.ordinary for w in BAD)


def test_held_out_labels_and_other_columns_do_not_matter(spark):
    rows = corpus(200, 4)
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = df.select("doc_id", "toxic")
    flipped = labels.withColumn("toxic", F.when(tx.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert tx.train(df, labels) == tx.train(df.repartition(7), flipped)


def plainly(rows, share):
    """The model and scores of (text, toxic) in memory, step by step."""
    toxic, ordinary = [t for t, y in rows if y], [t for t, y in rows if not y]
    windows = sorted((tx.window_rank(w), w) for t in ordinary for w in tx.trainer_windows(t))[: tx.TRAINER_WINDOWS]
    common = tx.trained([w for _, w in windows], tx.ORDINARY_BYTES, tx.SEGMENT) or b" "
    words = Counter(w for t in toxic for w in set(t.lower().split()))
    grams = [Counter(g for t in texts for g in {g for w in t.lower().split() for g in tx.strings(w)}) for texts in (toxic, ordinary)]
    own = {g for g, n in grams[0].items() if n >= max(tx.LEAST, tx.LEAST_SHARE * len(toxic)) and n / len(toxic) > tx.RATIO * (grams[1][g] + 0.5) / len(ordinary)}
    bad = tx.trained(tx.toxic_samples([(w, n) for w, n in words.items() if tx.strings(w) & own]), tx.TOXIC_BYTES, tx.TOXIC_SEGMENT) or b" "
    x = np.array([tx.features(t, common, bad) for t, _ in rows])
    order = sorted(range(len(rows)), key=lambda i: (rows[i][1], x[i].tolist()))
    return tx.Model(common, bad, tx.calibrated(x[order], np.array([float(rows[i][1]) for i in order]), share))


def test_model_and_scores_are_those_of_a_plain_version(spark):
    rows = corpus(400, 6)
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(5)
    model = tx.train(df, df.select("doc_id", "toxic"))
    seen = [(t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 5]
    want = plainly(seen, sum(y for _, y in seen) / len(seen))
    assert (model.ordinary, model.toxic) == (want.ordinary, want.toxic) and model.weights == pytest.approx(want.weights)
    for r in tx.score_documents(df, model, keep=("text",)).collect():
        assert r.score == pytest.approx(tx.score(r.text, want)) and r.predicted == (r.score >= 0.5)


def test_dictionaries_come_from_the_trainer_and_long_texts_teach_to_their_end(spark):
    rows = corpus(400, 7)
    late = [(i, ("x y z " * 20000 + t) if y else t, y) for i, t, y in rows]
    df = spark.createDataFrame(late, "doc_id long, text string, toxic int").repartition(5)
    model = tx.train(df, df.select("doc_id", "toxic"))
    magic = (0xEC30A437).to_bytes(4, "little")
    assert model.ordinary[:4] == magic and any(w.encode() in model.toxic for w in BAD)


def test_frequent_words_do_not_crowd_out_the_rest(spark):
    """Every word of a kind that toxic texts share is in the dictionary, however often the first ones occur."""
    rng = random.Random(8)
    rows = []
    for i in range(900):
        words, bad = wordy(rng, 60).split(), i % 3 == 0
        for _ in range(5 if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(BAD[:1] * 12 + BAD))
        rows.append((i, " ".join(words), int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(3)
    model = tx.train(df, df.select("doc_id", "toxic"))
    assert model.toxic[:4] == model.ordinary[:4] and all(w[1:-1].encode() in model.toxic for w in BAD)


def test_edge_cases(spark, messy, messy_rows, empty):
    model = tx.fit(spark.createDataFrame([(y, t) for _, t, y in corpus(60, 5)], "toxic int, text string"), 0.2)
    out = tx.score_documents(messy, model, keep=("text",)).collect()
    assert len(out) == len(messy_rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert len({r.score for r in out if not r.text}) == 1
    by = {}
    for r in out:
        assert by.setdefault(r.text, r.score) == r.score
    assert tx.score_documents(empty, model).count() == 0
    nothing = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.predicted for r in tx.score_documents(messy, tx.train(messy, nothing)).collect()} == {0}
    nulls = spark.createDataFrame([(None, 1), (3, None), (13, 0)], "doc_id long, toxic int")
    assert {r.predicted for r in tx.score_documents(messy, tx.train(messy, nulls)).collect()} == {0}
