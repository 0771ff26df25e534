import hashlib
import random
import re

from pyspark.sql import functions as F

from quire.llm import decontaminate as dc
from tests.llm.conftest import wordy

UP = str.maketrans(dc.UPPER, dc.UPPER.lower())


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UP))


def brute(docs, items, window=10):
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of (doc_id, text) rows, window by window."""
    wanted = {}
    for item, text in items:
        w = split(text)
        for s in range(max(len(w) - window, 0) + 1 if w else 0):
            wanted.setdefault(tuple(w[s : s + window]), set()).add("" if item is None else str(item))
    sizes = {len(w) for w in wanted}
    out = []
    for doc, text in docs:
        w, hit, found = split(text), set(), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                if ids := wanted.get(tuple(w[p : p + n])):
                    hit |= set(range(p, p + n))
                    found |= ids
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def near(docs, items, terms=dc.NEAR_TERMS, span=dc.NEAR_SPAN):
    texts = [split(t) for _, t in docs]
    count = {}
    for w in texts:
        for x in w:
            count[x] = count.get(x, 0) + 1
    asked = [("" if i is None else str(i), sorted(set(split(t)), key=lambda x: (count.get(x, 0), x))[:terms]) for i, t in items if len(set(split(t))) > 1]
    return [len({i for i, t in asked if any(set(t) <= set(w[p : p + span]) for p in range(len(w)) if w[p] in t)}) for w in texts]


def cases(messy_rows):
    rng = random.Random(4)
    items = [(k, wordy(rng, n)) for k, n in enumerate((40, 10, 11, 9, 3, 1, 200, 25))]
    items += [(8, items[0][1]), (9, items[0][1].upper()), (10, None), (11, " .;\n"), (None, wordy(rng, 12)), (12, "é ß x"), (12, wordy(rng, 30)), (13, "ab ab ab ab ab ab ab ab ab ab ab ab"), (14, wordy(rng, 30, "xyz"))]
    docs = [(r[0], r[1]) for r in messy_rows]
    long = items[6][1].split()
    passages = [items[0][1], items[1][1].replace(" ", ".\n"), items[2][1], items[3][1], items[4][1], items[5][1], " ".join(long[60:90]), items[-5][1], " ".join(["ab"] * 15), " ".join(long[:9]), " ".join(reversed(items[7][1].split()))]
    for k, p in enumerate(passages):
        docs += [(9000 + k, p), (9100 + k, f"{wordy(rng, 20)}; {p}, {wordy(rng, 20)}"), (9200 + k, f"--{wordy(rng, 5)} {p} {p}.")]
    docs += [docs[-1], docs[-1], (9300, " ".join(p for p in passages * 20))]
    return docs, items


def test_against_brute_force(spark, messy_rows):
    docs, items = cases(messy_rows)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5).withColumn("row", F.lit(7)).withColumn("unit", F.lit("x"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for few in (dc.FEW, 0):
        got = sorted((tuple(r) for r in dc.decontaminated(df, bench, few=few).collect()), key=repr)
        assert [g[:6] for g in got] == brute(docs, items)
        assert sorted((g[0] is None, g[0] or 0, g[6]) for g in got) == sorted((d is None, d or 0, n) for (d, _), n in zip(docs, near(docs, items), strict=True))
    assert sum(g[5] for g in got) > 25 and any(g[6] > g[3] for g in got)


def test_short_units_and_other_windows(spark, messy_rows):
    """Units that cut items into many, and windows of other lengths, give the same as whole items."""
    docs, items = cases(messy_rows)
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for window, unit in ((10, 1), (3, 4)):
        got = sorted((tuple(r)[:6] for r in dc.decontaminated(df, bench, window, unit).collect()), key=repr)
        assert got == brute(docs, items, window)


def test_empty_tables(spark, empty, messy_rows):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert dc.decontaminated(empty, bench).count() == 0
    docs = spark.createDataFrame([(1, "A, b? c"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in dc.decontaminated(docs, bench.limit(0)).collect()}
    assert [tuple(got[k])[1:4] for k in (1, 2)] == [(3, 0, 0), (0, 0, 0)] and not got[1].contaminated
    assert got[1].items_sha256 == hashlib.sha256(b"").hexdigest()
    got = {r.doc_id: r for r in dc.decontaminated(docs, bench).collect()}
    assert tuple(got[1])[1:4] == (3, 3, 1) and got[1].near_items == 1


def test_plan_has_no_python(spark, sf_dir):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    plan = dc.decontaminated(docs, bench)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
