import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import packing, toxicity
from tests.llm.test_fingerprints import shingle_set, words
from tests.llm.test_line_dedup import brute as lines_left
from tests.llm.test_mixing import waterfill
from tests.llm.test_ngram_join import brute
from tests.llm.test_toxicity import BAD, plainly

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def folder(spark, messy_rows, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(r[0], 1, int(i % 9 == 0)) for i, r in enumerate(messy_rows)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def test_stages_are_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "mixing sources to target weights", "packing"]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_every_stage_takes_messy_and_empty_documents(spark, messy, empty, folder, name):
    out = STAGES[name](spark, messy, folder)
    assert out.count() > 0
    if name != "packing":
        assert out.columns == messy.columns and dict(out.dtypes) == dict(messy.dtypes)
    assert STAGES[name](spark, empty, folder).count() == 0


def test_near_copies_leave_one_document(spark, messy, folder):
    got = STAGES["n-gram Jaccard join"](spark, messy.where("doc_id is not null"), folder).collect()
    rows = [(r.doc_id, r.text) for r in messy.where("doc_id is not null").collect()]
    assert sorted(r.doc_id for r in got) == sorted({c for _, _, c in brute(rows)})


def test_mix_repeats_and_cuts_documents(spark, messy, folder):
    docs = messy.where("doc_id is not null").dropDuplicates(["doc_id"])
    got = STAGES["mixing sources to target weights"](spark, docs, folder).collect()
    held = {r.doc_id: r for r in docs.collect()}
    sizes, taken = Counter(), Counter()
    for r in held.values():
        sizes[r.source] += len(words(r.text))
    for r in got:
        assert held[r.doc_id].text.startswith(r.text) and r.n_chars == len(r.text)
        taken[r.source] += len(words(r.text))
    for s, t in waterfill(dict(sizes)).items():
        assert abs(taken[s] - t) <= 1


def test_line_stage_keeps_documents_that_keep_a_line(spark, messy, folder):
    got = STAGES["line dedup"](spark, messy, folder)
    assert got.where("doc_id = 3").count() == 1 and got.where(F.col("n_chars") != F.length("text")).count() == 0


def test_run_packs_what_the_stages_leave(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.select("doc_id")
        docs = stage(spark, docs, sf_dir)
        assert docs.join(before, "doc_id", "left_anti").count() == 0
    encode = packing.encoder()
    tokens = sum(len(encode.encode_ordinary(r.text)) + 1 for r in docs.collect())
    assert rows.agg(F.sum("length")).first()[0] == tokens
    texts = {r.doc_id: shingle_set(r.text) for r in docs.collect()}
    assert len(texts) > 100


def plain_stages(spark, rows, labels):
    """doc_id, start, length, crc32, doc_tokens of the pieces, from rows (doc_id, text, source) in memory; labels: doc_id -> (quality, toxic)."""
    first = {}
    for d, t, _ in rows:
        first[d] = min(first.get(d, t or ""), t or "")
    learn = {d: y for d, (_, y) in labels.items() if zlib.crc32(str(d).encode()) % 5}
    model = plainly([(first[d], y) for d, y in learn.items() if d in first], sum(learn.values()) / len(learn))
    rows = [r for r in rows if toxicity.score(r[1] or "", model) < 0.5]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    left = cleaned(spark, df)
    rows = [(d, left[(d, t)][0], s) for d, t, s in rows if left[(d, t)][2] == 0 or left[(d, t)][2] < left[(d, t)][1]]
    named = {d: c for d, _, c in brute([(d, t) for d, t, _ in rows])}
    rows = sorted({(d, t, s) for d, t, s in rows if named[d] == d}, key=lambda r: (r[0], r[1] or ""))
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(words(t))
    budgets, out = {s: math.floor(t + 0.5) for s, t in waterfill(dict(sizes)).items()}, []
    for source, budget in budgets.items():
        own = []
        for d, t, s in rows:
            if s == source:
                u = (int(hashlib.md5(f"17:{d}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
                weight = {None: 1.0, 0: 0.5, 1: 2.0}[labels[d][0] if d in labels else None]
                own.append((-math.log(u) / weight, d, len(words(t)), t))
        epochs = budget // sizes[source] if sizes[source] else 0
        rest = budget - epochs * sizes[source]
        for _, d, n, t in sorted(own, key=lambda x: x[:3]):
            part = max(0, min(n, rest))
            rest -= part
            out += [(d, t)] * epochs * (n > 0)
            if part:
                out.append((d, t if part == n else "".join(re.findall(r"[ \t\n\x0b\x0c\r]*[^ \t\n\x0b\x0c\r]+", t)[:part])))
    pieces = []
    for d, t in out:
        ids = np.append(packing.token_ids(t), np.uint32(1)).astype("<u4")
        at = 0
        for n in packing.piece_lengths(len(ids)):
            pieces.append((d, at, n, zlib.crc32(ids[at : at + n].tobytes()), len(ids)))
            at += n
    return sorted(pieces)


def cleaned(spark, df):
    """(doc_id, text) -> text left, lines, lines lost."""
    keyed = {}
    for d, t, n, lost in lines_left(df.select("doc_id", "text"), None):
        keyed.setdefault(d, []).append((t, n, lost))
    out = {}
    for r in df.select("doc_id", "text").distinct().collect():
        mine = keyed[r.doc_id]
        out[(r.doc_id, r.text)] = next(m for m in mine if (m[0] is None) == (r.text is None) and m[1] == (len(r.text.split("\n")) if r.text is not None else 0))
    return out


def test_run_is_what_plain_stages_give(spark, messy_rows, tmp_path):
    rows = [(r[0], " ".join([r[1] or "", *(BAD * 3 if i % 7 == 3 else [])]) if i % 7 == 3 else r[1], r[3]) for i, r in enumerate(messy_rows) if r[0] is not None]
    rows += [(5000 + i, f"{BAD[i % 5]} {BAD[i % 3]} word{i} {BAD[i % 2]}" if i % 2 else f"plain words {i} and more of them", "b") for i in range(60)]
    labels = {d: (i % 2, int(any(b in (t or "") for b in BAD))) for i, (d, t, _) in enumerate(rows) if i % 4}
    docs = spark.createDataFrame([(d, t, "en", s, len(t) if t is not None else None) for d, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, q, y) for d, (q, y) in labels.items()], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect()
    assert sorted(map(tuple, got)) == plain_stages(spark, rows, labels) and len(got) > 100
