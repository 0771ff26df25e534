import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quire.llm import fingerprints as fp
from quire.llm import kernels


def words(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\x0b\x0c\r":
            out += [word] if word else []
            word = ""
        else:
            word += c.lower() if "A" <= c <= "Z" else c
    return out


def shingle_set(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_equal_shingles_have_equal_hashes_and_no_others(messy_rows):
    texts = [r[1] for r in messy_rows]
    seen = {}
    for i, hashes in kernels.shingles(pa.array(texts, type=pa.string())):
        own = kernels.distinct(hashes)
        assert len(own) == len(shingle_set(texts[i]))
        w = words(texts[i])
        for j, h in enumerate(hashes.tolist() if len(w) >= 5 else []):
            assert seen.setdefault(h, tuple(w[j : j + 5])) == tuple(w[j : j + 5])


def test_long_texts_are_hashed_as_their_parts(monkeypatch):
    text = " ".join(f"w{i}" for i in range(3000)) + " " + "y" * 3000 + " " + " ".join(f"v{i}" for i in range(50))
    whole = dict(kernels.shingles(pa.array([text])))[0]
    monkeypatch.setattr(kernels, "BLOCK", 700)
    monkeypatch.setattr(kernels, "_tables", {})
    cut = [s for _, s in kernels.shingles(pa.array([text, "a b c d e", ""]))]
    assert (cut[0] == whole).all() and len(cut[1]) == 1 and len(cut[2]) == 0


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 1 << 63, 4000, dtype=np.uint64), rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    a, b = np.r_[a, a[:2000]] * np.uint64(2), np.r_[b, a[:2000]] * np.uint64(2)
    b[-2000:] = a[:2000]
    merged = fp.merge(fp.bottom(a), fp.bottom(b))
    assert (merged == fp.bottom(np.r_[a, b])).all()
    assert abs(fp.resemblance(fp.bottom(a), fp.bottom(b)) - 2000 / 8000) < 0.15
    assert abs(fp.containment(fp.bottom(a), fp.bottom(b)) - 0.5) < 0.25
    assert abs(fp.distinct_count(fp.bottom(a)) / 4000 - 1) < 0.3
    assert fp.distinct_count(fp.bottom(a[:50])) == 50 and (fp.unpack(fp.pack(merged)) == merged).all()


def test_columns_and_merged_groups(spark, messy):
    sketched = messy.select("source", fp.sketch_column(F.col("text")).alias("s"))
    whole = {r.source: r.s for r in fp.merged(sketched, ["source"], "s", fan=3).collect()}
    for source, s in whole.items():
        parts = [fp.unpack(r.s) for r in sketched.where(F.col("source").eqNullSafe(source)).collect()]
        assert (fp.unpack(s) == fp.merge(*parts)).all()
    row = sketched.select(fp.likeness_column(F.col("s"), F.col("s")).alias("l"), fp.count_column(F.col("s")).alias("n")).agg(F.min("l"), F.min("n")).first()
    assert tuple(row) == (1.0, 0.0)


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def test_query_against_brute_force(spark, messy, messy_rows):
    more = [*messy_rows, *[(23, f"{x} {r[1]}", None, None, None) for x in "abc" for r in messy_rows[30:40]]]  # an id that many rows share
    df = spark.createDataFrame([(r[0], r[1]) for r in more], "doc_id long, text string").repartition(5)
    rows = fp.fingerprints(df, parts=4).collect()
    hashes = {r.t: r.h for r in df.select(F.coalesce("text", F.lit("")).alias("t")).select("t", F.xxhash64("t").alias("h")).collect()}
    order = sorted(more, key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1] or ""], r[1] or ""))
    assert len(rows) == len(order)
    want, likeness = [], {}
    for i, r in enumerate(order):
        text, after = r[1] or "", order[(i + 1) % len(order)][1] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        want.append((r[0], len(text), hashlib.sha256(edited.encode()).hexdigest()))
        likeness[want[-1]] = [shingle_set(x) for x in (text, edited, after)]
    key = lambda x: (x[0] is None, x[0] or 0, x[1], x[2])
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in rows), key=key) == sorted(want, key=key)
    marks, exact = {}, 0
    for r in rows:
        own, edited, after = likeness[(r.doc_id, r.n_chars, r.edited_sha256)]
        for got, other in ((r.near_edited, edited), (r.near_next, after)):
            true, small = jaccard(own, other), len(own | other) <= fp.K
            assert abs(got - true) <= (1e-12 if small else 5 * (true * (1 - true) / fp.K) ** 0.5 + 0.02)
            exact += small
        assert marks.setdefault(frozenset(own), r.fingerprint) == r.fingerprint
    assert 0 < exact < 2 * len(rows)


def test_few_rows(spark, empty):
    assert fp.fingerprints(empty).count() == 0
    one = spark.createDataFrame([(5, "a b c d e f g h i")], "doc_id long, text string")
    assert fp.fingerprints(one).first().edited_sha256 == hashlib.sha256(b"a b c d e f " + b"a b c").hexdigest()
    assert fp.fingerprints(spark.createDataFrame([(None, None)], "doc_id long, text string")).first().n_chars == 0
