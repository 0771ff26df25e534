import random

from pyspark.sql import functions as F

from quire.llm import line_dedup as ld
from tests.llm.conftest import wordy


def brute(df, rows):
    """Expected lines lost, from the chunks' line ranges: grouped by their bytes, not hashes; the first of each group stays."""
    chunks = {}
    for r in ld.chunk_rows(df.distinct(), ld.SEEDS).distinct().collect():
        chunks.setdefault((r.doc_id, r.row), []).append((r.first, r.last))
    keys = {(r.doc_id, r.row): r.text for r in df.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row")).distinct().collect()}
    groups = {}
    for key, spans in chunks.items():
        lines = keys[key].split("\n")
        for a, b in spans:
            groups.setdefault("\n".join(lines[a - 1 : b]), []).append(((key[0] is not None, key[0] or 0), key[1], a, b, key))
    lost = {}
    for places in groups.values():
        for _, _, a, b, key in sorted(places)[1:]:
            lost.setdefault(key, set()).update(range(a, b + 1))
    out = []
    for key, text in keys.items():
        lines = text.split("\n") if text is not None else None
        gone = lost.get(key, set())
        out.append((key[0], None if lines is None else "\n".join(x for i, x in enumerate(lines, 1) if i not in gone), len(lines or []), len(gone)))
    return out


def test_against_brute_force(messy, messy_rows):
    got = ld.dedup_lines(messy).select("doc_id", "text", "n_lines", "removed_lines").distinct().collect()
    want = brute(messy.select("doc_id", "text"), messy_rows)
    order = lambda r: (r[0] is None, r[0] or 0, r[1] or "", r[2])
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)
    assert ld.dedup_lines(messy).count() == len(messy_rows)
    assert set(ld.dedup_lines(messy).columns) == set(messy.columns) | {"n_lines", "removed_lines"}


def test_a_shared_passage_stays_once_wherever_it_stands(spark):
    rng = random.Random(2)
    passage = [wordy(rng, 14) for _ in range(6)]
    texts = ["\n".join([wordy(rng, 9) for _ in range(rng.randrange(1, 6))] + passage + [wordy(rng, 9) for _ in range(rng.randrange(6))]) for _ in range(40)]
    long = wordy(rng, 60)
    texts += [f"{wordy(rng, 5)}\n{long}\n{wordy(rng, 5)}" for _ in range(10)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = {r.doc_id: r for r in ld.dedup_lines(df).collect()}
    assert rows[0].removed_lines == rows[40].removed_lines == 0
    own = [x for t in texts for x in t.split("\n") if x not in passage and x != long]
    kept = [x for r in rows.values() for x in r.text.split("\n")]
    assert sorted(x for x in kept if x in set(own)) == sorted(own)
    assert kept.count(long) == 1
    assert all(1 <= kept.count(x) <= 20 for x in passage) and sum(kept.count(x) for x in passage) < 80


def test_blank_and_single_lines_are_left_alone(spark, empty):
    df = spark.createDataFrame([(1, "a\n\n\n\nb"), (2, "c\n\n\n\nd"), (3, "All rights reserved."), (4, "All rights reserved."), (5, None), (6, "")], "doc_id long, text string")
    assert all(r.removed_lines == 0 for r in ld.dedup_lines(df).collect())
    assert ld.dedup_lines(empty).count() == 0


def test_short_passages_are_always_found(spark):
    """Passages of 2 to 10 lines, each in two texts between random lines, some with a blank line inside."""
    rng = random.Random(5)
    texts, planted = [], []
    lengths = (2, 3, 4, 5, 6, 10)
    for k in range(120):
        passage = [wordy(rng, 14) for _ in range(lengths[k % 6])]
        planted.append(passage)
        shown = [passage[0], *([""] if k % 12 > 5 else []), *passage[1:]]
        texts += ["\n".join([wordy(rng, 9) for _ in range(rng.randrange(5))] + shown + [wordy(rng, 9) for _ in range(rng.randrange(5))]) for _ in range(2)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = {r.doc_id: r.text.split("\n") for r in ld.dedup_lines(df).collect()}
    left = {n: sum(any(x in rows[2 * k + 1] for x in p) for k, p in enumerate(planted) if len(p) == n) for n in lengths}
    assert left == dict.fromkeys(lengths, 0)
    assert all(x in rows[2 * k] for k, p in enumerate(planted) for x in p)
    shared = {x for p in planted for x in p} | {""}
    assert all(x in rows[i] for i, t in enumerate(texts) for x in t.split("\n") if x not in shared)


def test_lines_that_go_are_those_of_repeated_pairs_and_long_lines(spark, messy):
    """Without the operator's chunks: a line that isn't blank goes if it, with the next or the one before, or alone if it is long, stood earlier."""
    rng = random.Random(6)
    pool = [wordy(rng, 3, "ab") for _ in range(12)] + [""] * 4 + [wordy(rng, 60) for _ in range(2)]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 12))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").unionByName(messy.select("doc_id", "text").where("doc_id is not null").withColumn("doc_id", F.col("doc_id") + 1000)).dropDuplicates().repartition(4)
    seen, want = set(), {}
    rows = sorted((r.doc_id, r.row, r.text) for r in df.withColumn("row", F.xxhash64("doc_id", "text")).collect())
    for doc_id, row, text in rows:
        lines = text.split("\n") if text is not None else []
        full = [i for i, x in enumerate(lines) if x.strip(" ")]
        gone = set()
        for a, b in [*zip(full, full[1:], strict=False), *((i, i) for i in full if len(lines[i].split()) >= 50)]:
            key = "\n".join(lines[a : b + 1])
            if key in seen:
                gone |= {a, b}
            seen.add(key)
        want[(doc_id, text)] = [lines[i] for i in full if i not in gone]
    for r in ld.dedup_lines(df.withColumn("whole", F.col("text"))).collect():
        assert [x for x in (r.text or "").split("\n") if x.strip(" ")] == want[(r.doc_id, r.whole)]
