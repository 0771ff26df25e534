"""Signal and grid operators over embeddings read as 64-long signals or 8 x 8 grids, and image operators."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quire.functions import signal
from quire.operators import image, pages
from quire.plans.lines import table
from quire.sources import readers

QUERIES: dict = {}
SQL: dict = {}
SIGNAL = "s AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE embedding IS NOT NULL)"
ITEMS = f"{SIGNAL}, i AS (SELECT vec_id, unnest(v) AS x, unnest(range(0, len(v))) AS i FROM s)"
LEVELS = "g AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(least(greatest(floor((x::DOUBLE + 1) * 128), 0), 255) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL)"


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def _signals(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where("embedding is not null").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def _levels(spark, sf_dir):
    """0..255 grey levels."""
    return _signals(spark, sf_dir).select("vec_id", F.transform("v", lambda x: F.least(F.greatest(F.floor((x + 1) * 128), F.lit(0)), F.lit(255))).alias("v"))


def _exploded(df, column: str, name: str = "value"):
    return df.select("vec_id", F.posexplode(column).alias("i", name)).withColumn("i", F.col("i").cast("long"))


@query("first_diff", f"WITH {ITEMS}, d AS (SELECT vec_id, i - 1 AS i, x - lag(x) OVER (PARTITION BY vec_id ORDER BY i) AS value FROM i) SELECT vec_id, i, round(value, 6) + 0.0 AS value FROM d WHERE i >= 0")
def first_diff(spark, sf_dir):
    return _exploded(_signals(spark, sf_dir).select("vec_id", signal.differences(F.col("v")).alias("d")), "d").withColumn("value", F.round("value", 6) + 0.0)


_W = signal.gaussian_weights(2.0)
_MIRROR = "CASE WHEN ((i.i + k.d) % 128 + 128) % 128 < 64 THEN ((i.i + k.d) % 128 + 128) % 128 ELSE 127 - ((i.i + k.d) % 128 + 128) % 128 END"


@query("gauss_smooth", f"WITH {ITEMS}, k(d, w) AS (VALUES {', '.join(f'({n - len(_W) // 2}, {w!r}::DOUBLE)' for n, w in enumerate(_W))}), m AS (SELECT i.vec_id, i.i, k.w, {_MIRROR} AS j FROM i, k) SELECT m.vec_id, m.i, round(sum(m.w * i.x), 5) + 0.0 AS value FROM m JOIN i ON i.vec_id = m.vec_id AND i.i = m.j GROUP BY m.vec_id, m.i")
def gauss_smooth(spark, sf_dir):
    return _exploded(_signals(spark, sf_dir).select("vec_id", signal.smoothed(F.col("v"), 2.0).alias("s")), "s").withColumn("value", F.round("value", 5) + 0.0)


@query("autocorr", f"WITH {ITEMS}, c AS (SELECT vec_id, i, x - avg(x) OVER (PARTITION BY vec_id) AS x FROM i), p AS (SELECT a.vec_id, b.i - a.i AS lag, sum(a.x * b.x) AS r FROM c a JOIN c b ON a.vec_id = b.vec_id AND b.i - a.i BETWEEN 0 AND 15 GROUP BY ALL) SELECT p.vec_id, p.lag AS i, round(p.r / (z.r + 1e-10), 5) + 0.0 AS value FROM p JOIN p z ON z.vec_id = p.vec_id AND z.lag = 0")
def autocorr(spark, sf_dir):
    return _exploded(_signals(spark, sf_dir).select("vec_id", signal.autocorrelation(F.col("v"), 16).alias("a")), "a").withColumn("value", F.round("value", 5) + 0.0)


MAXIMA = f"{ITEMS}, n AS (SELECT *, lag(x) OVER (PARTITION BY vec_id ORDER BY i) AS a, lead(x) OVER (PARTITION BY vec_id ORDER BY i) AS b FROM i), p AS (SELECT vec_id, i, x, lead(i) OVER (PARTITION BY vec_id ORDER BY i) AS nxt, row_number() OVER (PARTITION BY vec_id ORDER BY i) - 1 AS k FROM n WHERE x > a AND x > b)"


@query("local_maxima", f"WITH {MAXIMA} SELECT vec_id, count(*) AS peaks, CAST(min(i) AS INTEGER) AS first_peak, CAST(sum(i) AS BIGINT) AS positions FROM p GROUP BY vec_id")
def local_maxima(spark, sf_dir):
    found = _signals(spark, sf_dir).select("vec_id", signal.local_maxima(F.col("v")).alias("p")).where("size(p) > 0")
    return found.select("vec_id", F.size("p").cast("long").alias("peaks"), F.col("p")[0].alias("first_peak"), F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x).alias("positions"))


@query("valley_argmin", f"WITH {MAXIMA} SELECT p.vec_id, p.k AS i, CAST(arg_min(i.i, (i.x, i.i)) AS INTEGER) AS valley FROM p JOIN i ON i.vec_id = p.vec_id AND i.i >= p.i AND i.i < p.nxt GROUP BY p.vec_id, p.k")
def valley_argmin(spark, sf_dir):
    return _exploded(_signals(spark, sf_dir).select("vec_id", signal.valleys(F.col("v")).alias("w")), "w", "valley")


@query("otsu_threshold", f"WITH {LEVELS}, t AS (SELECT vec_id, unnest(list_distinct(v)) AS t, v FROM g), q AS (SELECT vec_id, t, len(v)::DOUBLE AS n, list_sum(v)::DOUBLE AS total, len(list_filter(v, lambda x: x <= t))::DOUBLE AS c, list_sum(list_filter(v, lambda x: x <= t))::DOUBLE AS s FROM t), b AS (SELECT vec_id, t, CASE WHEN c = n THEN 0 ELSE (s * n - total * c) * (s * n - total * c) / (c * (n - c)) END AS b FROM q) SELECT vec_id, CAST(arg_max(t, (b, -t)) AS BIGINT) AS threshold FROM b GROUP BY vec_id")
def otsu_threshold(spark, sf_dir):
    return _levels(spark, sf_dir).select("vec_id", signal.otsu(F.col("v")).cast("long").alias("threshold"))


@query("projection_variance", f"WITH {LEVELS}, r AS (SELECT vec_id, unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS row, v FROM g), s AS (SELECT vec_id, row, list_sum(v[row * 8 + 1 : row * 8 + 8])::DOUBLE AS total FROM r) SELECT vec_id, round(var_pop(total), 4) AS variance, max(total) AS most FROM s GROUP BY vec_id")
def projection_variance(spark, sf_dir):
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.aggregate(F.slice("v", r * 8 + 1, F.lit(8)), F.lit(0.0), lambda a, x: a + x))
    return _levels(spark, sf_dir).select("vec_id", rows.alias("r")).select("vec_id", F.round(signal.variance(F.col("r")), 4).alias("variance"), F.array_max("r").alias("most"))


@query("seam_dp", f"""WITH RECURSIVE {LEVELS}, d(vec_id, v, c, m) AS (SELECT vec_id, v, 0, [v[1], v[9], v[17], v[25], v[33], v[41], v[49], v[57]] FROM g UNION ALL
SELECT vec_id, v, c + 1, [v[r * 8 + c + 2] + least(m[r + 1], CASE WHEN r > 0 THEN m[r] ELSE m[r + 1] END, CASE WHEN r < 7 THEN m[r + 2] ELSE m[r + 1] END) FOR r IN [0, 1, 2, 3, 4, 5, 6, 7]] FROM d WHERE c < 7)
SELECT vec_id, CAST(list_min(m) AS BIGINT) AS cost FROM d WHERE c = 7""")
def seam_dp(spark, sf_dir):
    return _levels(spark, sf_dir).select("vec_id", signal.seam_cost(F.col("v"), 8, 8).cast("long").alias("cost"))


@query("brightness_clip", f"WITH {LEVELS} SELECT vec_id, round(list_sum(list_transform(v, lambda x: least(greatest(x * 1.1::DOUBLE - 12, 0), 255))), 4) AS total FROM g")
def brightness_clip(spark, sf_dir):
    return _levels(spark, sf_dir).select("vec_id", F.round(signal.total(signal.brightness(F.transform("v", lambda x: x.cast("double")), 1.1, -12.0)), 4).alias("total"))


PIXELS = f"{LEVELS}, p AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, v[i + 1] AS v FROM (SELECT vec_id, v, unnest(range(0, 64)) AS i FROM g))"


def _by_image(spark, sf_dir, schema: str, of):
    """vec_id and what ``of(8 x 8 grey levels)`` returns."""
    names = [c.split()[0] for c in schema.split(", ")]

    def each(batches):
        for pdf in batches:
            yield pd.DataFrame([(i, *of(np.asarray(v, dtype=np.uint8).reshape(8, 8))) for i, v in zip(pdf["vec_id"], pdf["v"], strict=True)], columns=["vec_id", *names])

    return _levels(spark, sf_dir).mapInPandas(each, f"vec_id long, {schema}")


@query("distance_transform", f"WITH {PIXELS}, d AS (SELECT a.vec_id, a.y, a.x, min(sqrt((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x))) AS d FROM p a JOIN p b ON a.vec_id = b.vec_id AND b.v >= 128 WHERE a.v < 128 GROUP BY ALL) SELECT vec_id, round(sum(d), 5) AS total, round(max(d), 5) AS furthest FROM d GROUP BY vec_id")
def distance_transform(spark, sf_dir):
    """Distances of ink to the nearest blank pixel, of grids that have both."""

    def of(grey):
        d = image.distance_to_blank(grey < 128)
        return float(d.sum()), float(d.max()), bool((grey < 128).any() and (grey >= 128).any())

    return _by_image(spark, sf_dir, "total double, furthest double, mixed boolean", of).where("mixed").select("vec_id", F.round("total", 5).alias("total"), F.round("furthest", 5).alias("furthest"))


ROUND = "o(dy, a, b) AS (VALUES (-2, 0, 0), (-1, -2, 2), (0, -2, 2), (1, -2, 2), (2, 0, 0))"


@query("closing_round", f"WITH {PIXELS}, {ROUND}, h AS (SELECT q.vec_id, q.y, q.x, max(p.v) AS v FROM p q JOIN o ON true JOIN p ON p.vec_id = q.vec_id AND p.y = q.y + dy AND p.x BETWEEN q.x + a AND q.x + b GROUP BY ALL), c AS (SELECT q.vec_id, q.y, q.x, min(h.v) AS v FROM p q JOIN o ON true JOIN h ON h.vec_id = q.vec_id AND h.y = q.y + dy AND h.x BETWEEN q.x + a AND q.x + b GROUP BY ALL) SELECT vec_id, CAST(sum(v) AS BIGINT) AS total, CAST(sum(v * (y * 8 + x)) AS BIGINT) AS placed FROM c GROUP BY vec_id")
def closing_round(spark, sf_dir):
    """The background of a grid: greatest, then least level of a round neighbourhood of 5."""

    def of(grey):
        c = image.closing(grey, [(d, -half, half) for d, half in image.ellipse(5)]).astype(int).ravel()
        return int(c.sum()), int((c * np.arange(64)).sum())

    return _by_image(spark, sf_dir, "total long, placed long", of)


_REFLECTED = "CASE WHEN {0} < 0 THEN -{0} WHEN {0} > 7 THEN 14 - {0} ELSE {0} END"


@query("sauvola_ink", f"WITH {PIXELS}, k AS (SELECT unnest(range(-2, 3)) AS d), n AS (SELECT q.vec_id, q.y, q.x, q.v AS own, avg(p.v::DOUBLE) AS m, avg(p.v::DOUBLE * p.v) AS m2 FROM p q JOIN k a ON true JOIN k b ON true JOIN p ON p.vec_id = q.vec_id AND p.y = {_REFLECTED.format('(q.y + a.d)')} AND p.x = {_REFLECTED.format('(q.x + b.d)')} GROUP BY ALL) SELECT vec_id, count(*) FILTER (WHERE own <= m * (1 + 0.2 * (sqrt(greatest(m2 - m * m, 0)) / 127.5 - 1))) AS ink FROM n GROUP BY vec_id")
def sauvola_ink(spark, sf_dir):
    """Pixels at or below the local threshold of windows of 5."""
    return _by_image(spark, sf_dir, "ink long", lambda grey: (int((image.sauvola(grey, image.Recipe(window=5)) == 0).sum()),))


def _pages(pdf: pd.DataFrame):
    """A 96 x 128 page of text-like lines for each vector, slightly skewed."""
    for vec_id, v in zip(pdf["vec_id"], pdf["v"], strict=True):
        v = np.asarray(v, dtype=float)
        page = np.full((96, 128), 255.0)
        for k in range(4):
            top = 10 + 22 * k
            page[top : top + 9, 8:120] = 255 - 200 * (np.tile(np.abs(v), 2)[None, : 112] > 0.05)
        yield vec_id, np.clip(image.rotate(page, float(np.clip(v[0] * 6, -3, 3))), 0, 255).astype(np.uint8)


IMAGES = "vec_id long, angle double, threshold int, denoised_mean double, ink_share double, lines int, first_height int, augmented_mean double"


@query("page_images")
def page_images(spark, sf_dir):
    """Deskew, denoise, Sauvola binarisation, line segmentation, seam crops and augmentation of a page for each vector."""

    def each(batches):
        for pdf in batches:
            out = []
            for vec_id, grey in _pages(pdf):
                angle = image.skew_angle(grey)
                straight = image.deskew(grey, angle=angle)
                clean = image.denoise(straight)
                binary = image.sauvola(clean)
                found = image.segment(binary)
                first = image.crop(straight, *found[0]).shape[0] if found else 0
                varied = image.augment(straight, np.random.default_rng(int(vec_id)))
                out.append((int(vec_id), round(angle, 3), image.otsu_level(grey), float(clean.mean()), float((binary < 128).mean()), len(found), first, float(varied.mean())))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in IMAGES.split(", ")])

    return _signals(spark, sf_dir).repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInPandas(each, IMAGES)


@query("page_lines")
def page_lines(spark, sf_dir):
    """PNG files of a page for each vector, cut into line images: names, sizes and checksums of the files that come out."""

    def drawn(batches):
        for pdf in batches:
            yield pd.DataFrame([(f"pages/source1_page{vec_id:03d}.png", readers.encode_png(grey)) for vec_id, grey in _pages(pdf)], columns=["path", "content"])

    signals = _signals(spark, sf_dir).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = pages.line_images(signals.mapInPandas(drawn, "path string, content binary"))
    return found.select("page", "line", "name", "height", "width", F.crc32("png").alias("png_crc32"))
