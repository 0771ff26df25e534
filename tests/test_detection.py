import random

from pyspark.sql import functions as F

from quire.operators import detection, order

BOX = "path string, cls int, box_no long, x1 double, y1 double, x2 double, y2 double"


def iou(a, b):
    w, h = (max(0.0, min(a[k + 2], b[k + 2]) - max(a[k], b[k])) for k in (0, 1))
    area = lambda r: max(0.0, r[2] - r[0]) * max(0.0, r[3] - r[1])
    whole = area(a) + area(b) - w * h
    return w * h / whole if whole else 0.0


def brute(truth, found, levels):
    """(cls, level): (n_truth, n_found, right, ap), by lists."""
    out = {}
    for cls in {t[1] for t in truth}:
        for level in levels:
            claims = {}
            for f in (f for f in found if f[1] == cls):
                best = max(((iou(f[3:7], t[3:7]), -t[2], t) for t in truth if t[:2] == f[:2]), default=None)
                if best and best[0] >= levels[0] and best[0] >= level:
                    claims.setdefault((f[0], best[2][2]), []).append(f)
            right = {min(c, key=lambda f: (-f[7], f[2]))[:3] for c in claims.values()}
            ranked = sorted((f for f in found if f[1] == cls), key=lambda f: (-f[7], f[0], f[2]))
            n, hits, precision = sum(t[1] == cls for t in truth), 0, []
            for k, f in enumerate(ranked, 1):
                hits += f[:3] in right
                precision.append(hits / k)
            area = sum(max(precision[k:]) for k, f in enumerate(ranked) if f[:3] in right)
            out[cls, level] = (n, len(ranked), hits, area / n)
    return out


def boxes(seed, pages=12):
    rng = random.Random(seed)
    truth, found = [], []
    for p in range(pages):
        for k in range(rng.randrange(5)):
            x, y = rng.randrange(60), rng.randrange(60)
            cls, box = rng.randrange(3), (x, y, x + rng.randrange(1, 30), y + rng.randrange(1, 30))
            truth.append((f"p{p}", cls, k, *map(float, box)))
            for j in range(rng.randrange(4)):
                near = [float(v + rng.choice([0, 0, 0, 1, -1, 3])) for v in box]
                found.append((f"p{p}", rng.choice([cls, cls, cls, 1]), 10 * k + j, *near, rng.choice([0.3, 0.5, 0.5, 0.7, 0.9])))
    found += [("nowhere", 0, 0, 0.0, 0.0, 5.0, 5.0, 0.99), ("p0", 7, 99, 0.0, 0.0, 5.0, 5.0, 0.5), ("p1", 1, 99, 5.0, 5.0, 5.0, 5.0, 0.5)]
    return truth + [("lonely", 5, 0, 0.0, 0.0, 9.0, 9.0)], found


def test_average_precision_against_lists(spark):
    for seed in range(3):
        truth, found = boxes(seed)
        a, b = spark.createDataFrame(truth, BOX).repartition(3), spark.createDataFrame(found, f"{BOX}, conf double").repartition(4)
        classes, summary = detection.evaluated(a, b)
        rows = classes.collect()
        want = brute(truth, found, detection.OVERLAPS)
        assert {(r.cls, r.level) for r in rows} == set(want)
        for r in rows:
            n, found_n, right, ap = want[r.cls, r.level]
            assert (r.n_truth, r.n_found, r.right) == (n, found_n, right) and abs(r.ap - ap) < 1e-12
            assert 0 <= r.precision <= 1 and 0 <= r.recall <= 1
        s = summary.first()
        assert abs(s.map50 - sum(v[3] for k, v in want.items() if k[1] == 0.5) / len({k[0] for k in want})) < 1e-12
        assert abs(s.map50_95 - sum(v[3] for v in want.values()) / len(want)) < 1e-12


def test_nothing_found_or_nothing_there(spark):
    truth, found = boxes(1)
    a, b = spark.createDataFrame(truth, BOX), spark.createDataFrame(found, f"{BOX}, conf double")
    none = detection.by_class(a, b.limit(0)).collect()
    assert all((r.n_found, r.right, r.ap, r.recall) == (0, 0, 0.0, 0.0) for r in none) and len(none) == 10 * len({t[1] for t in truth})
    assert detection.by_class(a.limit(0), b).count() == 0


def test_corners(spark):
    df = spark.createDataFrame([(0.5, 0.25, 0.5, 0.5)], "cx double, cy double, w double, h double")
    got = df.select(*detection.corners(F.col("cx"), F.col("cy"), F.col("w"), F.col("h"), F.lit(200), F.lit(100))).first()
    assert tuple(got) == (50.0, 0.0, 150.0, 50.0)


def test_running_sums_and_later_maxima(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), k, rng.randrange(50)) for k in range(400)]
    df = spark.createDataFrame(rows, "g string, k long, v long").repartition(7)
    got = {r.k: (r.s, r.m) for r in order.running(df, ["g"], [F.col("k").desc()], {"s": F.col("v")}, {"m": F.col("v")}).collect()}
    for g in ("a", "b", None):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: -r[1])
        for i, r in enumerate(own):
            assert got[r[1]] == (sum(x[2] for x in own[: i + 1]), max(x[2] for x in own[i:]))
