import random
from collections import Counter

import numpy as np
import pytest

from quire.llm import dealing
from quire.llm import ngram_join as nj
from tests.llm.test_fingerprints import shingle_set


def brute(rows, percent=80):
    """doc_id -> (size, smallest id of its component); for rows with ids."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    lists = {}
    for i, s in enumerate(sets):
        common = Counter(j for e in s for j in lists.get(e, ()))
        for j, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                parent[find(i)] = find(j)
        for e in s:
            lists.setdefault(e, []).append(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize(("short", "block"), [(64, 512), (2, 512), (2, 3), (3, 1)])
def test_messy_documents(messy, messy_rows, short, block):
    """Also with lists and families so short that long lists, hot shingles and pairs of blocks come into play."""
    rows = [(r[0], r[1]) for r in messy_rows if r[0] is not None]
    got = nj.join_components(messy.where("doc_id is not null"), short=short, block=block, chunk=700 * block)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_common_passages_and_chains_of_near_copies(spark):
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(3000)}"
    common, base = [word() for _ in range(60)], [word() for _ in range(100)]
    rows = []
    for i in range(150):
        rows.append((i, " ".join([word() for _ in range(rng.randrange(5, 60))] + common + [word() for _ in range(rng.randrange(0, 30))])))
    for i in range(150, 260):
        w = list(base)
        for _ in range(rng.randrange(5)):
            w[rng.randrange(100)] = word()
        rows.append((i, " ".join(w)))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for short in (64, 5):
        assert sorted(map(tuple, nj.join_components(df, short=short, block=40).collect())) == brute(rows)


def test_null_ids_and_empty_tables(spark, messy, messy_rows, empty):
    assert nj.join_components(empty).count() == 0
    rows = [r for r in nj.join_components(messy).collect() if r.doc_id is None]
    assert sorted((r.n_shingles, r.component_id is None) for r in rows) == [(0, True), (116, False)]


def test_block_overlaps_derive_from_the_set_before():
    rng = np.random.default_rng(4)
    pool = rng.integers(0, 1 << 60, 400, dtype=np.uint64)
    sets = [np.unique(np.r_[pool[k % 9 : 90 + k % 9], rng.choice(pool, 12)]) for k in range(40)]
    linked = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))

    def classes(n, links):
        label = list(range(n))
        for x, y in links:
            a, b = label[x], label[y]
            label = [min(a, b) if v in (a, b) else v for v in label]
        return label

    all_links = [(i, j) for i in range(40) for j in range(i) if linked(sets[i], sets[j])]
    assert classes(40, nj.block_links(sets, None)) == classes(40, all_links)
    cross = [(i, j) for i, j in all_links if (i < 20) != (j < 20)]
    assert classes(40, nj.block_links(sets[:20], sets[20:])) == classes(40, cross)


def test_block_skipping_gives_just_the_pairs_that_can_reach_the_overlap():
    rng = np.random.default_rng(9)
    rows = sorted({(int(key), int(n), int(r), i) for i, (key, n, r) in enumerate(zip(rng.integers(0, 60, 900), rng.integers(10, 60, 900), rng.integers(0, 12, 900), strict=True)) if r < nj.prefix_length(n)})
    key, n, rank = (np.array([r[k] for r in rows]) for k in range(3))
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    got = [(int(x), int(y)) for a, b in nj.compatible_pairs(starts, sizes, n, rank, 64, 80) for x, y in zip(a, b, strict=True)]
    reach = lambda x, y: 1 + min(n[x] - rank[x] - 1, n[y] - rank[y] - 1) + min(rank[x], rank[y]) >= nj.least_overlap(n[x] + n[y])
    assert sorted(got) == [(x, y) for x in range(len(n)) for y in range(x + 1, len(n)) if key[x] == key[y] and 100 * n[x] >= 80 * n[y] and reach(x, y)] and len(got) > 100


def test_prefixes_are_dealt_evenly():
    """Prefixes hold the smallest hashes; the bucket does not follow from these."""
    rng = np.random.default_rng(10)
    posted = np.concatenate([np.sort(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))[: nj.prefix_length(n)] for n in rng.integers(50, 400, 3000)])
    sizes = np.bincount(nj.bucket_of(posted, 50).astype(int), minlength=50)
    assert sizes.max() < 1.1 * sizes.mean() and sizes.min() > 0.9 * sizes.mean()


def test_a_passage_of_many_unrelated_texts_makes_no_family(spark):
    """However many shingles are frequent: a shared passage of 20 words comes last in the order, so it posts nothing."""
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage = [word() for _ in range(20)]
    rows = [(i, " ".join([word() for _ in range(40)] + passage + [word() for _ in range(40)])) for i in range(600)]
    rows += [(600 + i, rows[0][1] + f" x{i}") for i in range(3)]
    texts = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).selectExpr("spark_partition_id() part", "text")
    edges = nj.candidate_edges(texts, 4, 8, 5, short=8, limit=4000).collect()
    assert {x for e in edges for x in (e.a, e.b)} == {nj.set_id(np.unique(s)) for _, s in nj.kernels.shingles(nj.pa.array([rows[k][1] for k in (0, 600, 601, 602)]))}


def test_chunks_do_not_depend_on_batches():
    pa = nj.pa
    texts = [None, "", "ab", "cdé", "x" * 50, *["yz"] * 40]
    whole = pa.RecordBatch.from_arrays([pa.array([7] * len(texts)), pa.array(texts)], names=["part", "text"])
    for step in (1, 3, 100):
        got = [(c, t.column(0).to_pylist()) for c, t in dealing.chunks([whole.slice(i, step) for i in range(0, len(texts), step)], 10)]
        assert [t for _, x in got for t in x] == texts and [c for c, _ in got] == [(7 << 32) + i for i in range(len(got))]
        assert got == [(c, t.column(0).to_pylist()) for c, t in dealing.chunks([whole], 10)]


def test_bounds():
    for n in range(1, 200):
        assert nj.prefix_length(n) == n - -(-80 * n // 100) + 1
        assert nj.least_overlap(2 * n) == min(c for c in range(n + 1) if 100 * c >= 80 * (2 * n - c))
