import numpy as np
import pytest

from quire.llm import embedding_dedup as ed


def vectors():
    rng = np.random.default_rng(6)
    rows, centres = [], rng.normal(size=(12, 16))
    for i in range(420):
        v = centres[i % 12] + rng.normal(size=16) * (0.02 if i % 12 == 0 else 0.25)
        rows.append((i, v.tolist(), i % 3))
    rows += [(1000 + i, (centres[0] + rng.normal(size=16) * 0.01).tolist(), 0) for i in range(150)]
    rows += [(2000, None, 0), (2001, [], 0), (2002, [0.0] * 16, 0), (2003, [1.0] * 15 + [float("nan")], 0), (2004, [1.0] * 15 + [float("inf")], 0), (2005, [1.0] * 15 + [None], 0), (2006, centres[0].tolist(), None), (None, centres[0].tolist(), 0), (2007, [1.0, 2.0], 0), (2008, [1e300 * float(x) for x in centres[0]], 0), (2009, [2.0, 4.0], 0), (5, rows[5][1], rows[5][2])]
    return rows


def brute(rows, cosine=0.93):
    held = {r[0]: r for r in rows}
    use = [r for r in held.values() if r[0] is not None and r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    links = {r[0]: 0 for r in held.values()}
    parent = {r[0]: r[0] for r in held.values()}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(use):
        for b in use[:i]:
            if a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = (np.array(v[1]) / np.abs(v[1]).max() for v in (a, b))
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                    links[a[0]] += 1
                    links[b[0]] += 1
                    p, q = sorted((find(a[0]), find(b[0])))
                    parent[q] = p
    return {k: (links[k], find(k), find(k) == k) for k in links}


@pytest.mark.parametrize(("cell", "block"), [(4096, None), (40, 16), (15, 7)])
def test_against_brute_force(spark, cell, block):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in ed.near_duplicates(df, cell=cell, block=block).collect()}
    assert got == brute(rows)


def by_label(ids, labels, x, cosine=0.93):
    """vec_id: links and component, label by label in matrices."""
    out = {}
    for label in np.unique(labels):
        own, v = ids[labels == label], x[labels == label]
        v = v / np.linalg.norm(v, axis=1, keepdims=True)
        links = v @ v.T >= cosine
        component, before = own.copy(), None
        while before is None or (component != before).any():
            before, component = component, np.where(links, component[None, :], np.iinfo(np.int64).max).min(axis=1)
        out |= {int(i): (int(n) - 1, int(c)) for i, n, c in zip(own, links.sum(axis=1), component, strict=True)}
    return out


def clustered(labels, dim=8):
    rng = np.random.default_rng(8)
    place = np.zeros(len(labels), np.int64)
    for label in np.unique(labels):
        place[labels == label] = np.arange((labels == label).sum()) // 4
    centres = rng.normal(size=(place.max() + 1, dim))
    return centres[place] + rng.normal(size=(len(labels), dim)) * 0.1


def found(spark, labels, x, **how):
    rows = [(i, v.tolist(), int(label)) for i, (v, label) in enumerate(zip(x, labels, strict=True))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    return {r.vec_id: (r.n_links, r.component_id) for r in ed.near_duplicates(df, **how).collect()}


def test_every_label_has_a_pivot(spark):
    """Labels of 400, 4,000 and 40 vectors; of label 48 no row's hash is among those drawn."""
    n = np.arange(20_000)
    labels = np.concatenate([n % 50, np.full(4000, 50), 51 + n[:4000] % 100])
    x = clustered(labels)
    got, want = found(spark, labels, x), by_label(np.arange(len(labels)), labels, x)
    assert sum(want[i][0] for i in n[labels[:20_000] == 48].tolist()) > 0
    assert got == want


@pytest.mark.parametrize("block", [None, 16])
def test_groups_beyond_the_pivots(spark, block):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in ed.near_duplicates(df, block=block, most=1).collect()}
    assert got == brute(rows)


def test_more_labels_than_pivots(spark):
    labels = np.arange(6600) % 2200
    x = clustered(labels)
    assert found(spark, labels, x) == by_label(np.arange(len(labels)), labels, x)


def test_empty_and_useless_tables(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert ed.near_duplicates(df).count() == 0
    lone = spark.createDataFrame([(1, None, 1), (2, [0.0], None)], "vec_id long, embedding array<float>, label int")
    assert sorted(map(tuple, ed.near_duplicates(lone).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_products_near_the_threshold_are_summed_exactly():
    a = np.array([[1.0, 0.0]])
    b = np.array([[0.6, 0.8], [0.5999999999999, 0.8]])
    assert ed.block_links(a, b, 0.6).tolist() == [[True, False]]
