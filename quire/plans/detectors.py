"""Quality of detectors, over boxes made of the rows of lineitem: an order is a page."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import detection
from quire.plans.lines import table

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


BOXES = """b AS (SELECT 'p' || l_orderkey AS path, CAST(l_partkey % 3 AS INTEGER) AS cls, (l_partkey * 10000 + l_suppkey) * 10 + l_linenumber AS box_no, l_partkey AS k, l_suppkey AS s, l_quantity AS x, l_discount * 100 AS y, round(l_extendedprice) % 700 / 1000.0::DOUBLE AS c FROM lineitem),
t AS (SELECT path, cls, box_no, x AS x1, y AS y1, x + 30 AS x2, y + 20 AS y2 FROM b),
f AS (SELECT path, cls, box_no, x + s % 9 AS x1, y + k % 4 AS y1, x + 30 + s % 5 AS x2, y + 20 AS y2, 0.3::DOUBLE + c AS conf FROM b WHERE k % 5 <> 0
  UNION ALL SELECT path, cls, -box_no, x + CASE WHEN s % 2 = 0 THEN 3 ELSE 300 END, y, x + 33 + CASE WHEN s % 2 = 0 THEN 0 ELSE 300 END, y + 19, 0.25::DOUBLE + c / 2 FROM b WHERE s % 4 < 2)"""
CURVES = f"""{BOXES}, o(level) AS (SELECT unnest([0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]::DOUBLE[])),
p AS (SELECT f.path, f.cls, f.box_no, f.conf, t.box_no AS n, greatest(0, least(f.x2, t.x2) - greatest(f.x1, t.x1)) * greatest(0, least(f.y2, t.y2) - greatest(f.y1, t.y1)) AS i, (f.x2 - f.x1) * (f.y2 - f.y1) + (t.x2 - t.x1) * (t.y2 - t.y1) AS a FROM f JOIN t ON f.path = t.path AND f.cls = t.cls),
u AS (SELECT path, cls, box_no, conf, n, i / (a - i) AS iou, row_number() OVER (PARTITION BY path, cls, box_no ORDER BY i / (a - i) DESC, n) AS r FROM p),
w AS (SELECT path, cls, box_no, level, row_number() OVER (PARTITION BY path, cls, n, level ORDER BY conf DESC, box_no) AS r FROM u JOIN o ON iou >= level WHERE r = 1),
g AS (SELECT f.path, f.cls, f.box_no, f.conf, o.level, CASE WHEN w.r = 1 THEN 1 ELSE 0 END AS hit FROM f CROSS JOIN o LEFT JOIN w ON w.path = f.path AND w.cls = f.cls AND w.box_no = f.box_no AND w.level = o.level),
n AS (SELECT cls, count(*) AS n_truth FROM t GROUP BY cls),
q AS (SELECT *, sum(hit) OVER v AS tp, count(*) OVER v AS k FROM g WINDOW v AS (PARTITION BY cls, level ORDER BY conf DESC, path, box_no ROWS UNBOUNDED PRECEDING)),
c AS (SELECT q.*, tp::DOUBLE / k AS pr, tp::DOUBLE / n_truth AS rc, n_truth, max(tp::DOUBLE / k) OVER (PARTITION BY q.cls, level ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env FROM q JOIN n ON n.cls = q.cls),
r AS (SELECT cls, level, any_value(n_truth) AS n_truth, count(*) AS n_found, CAST(sum(hit) AS BIGINT) AS "right", coalesce(sum(env) FILTER (WHERE hit = 1), 0) / any_value(n_truth) AS ap,
  max({{'f': CASE WHEN pr + rc = 0 THEN 0 ELSE 2 * pr * rc / (pr + rc) END, 'conf': conf, 'p': pr, 'r': rc}}) AS top FROM c GROUP BY cls, level)"""


def _boxes(spark, sf_dir):
    """True boxes and found ones: most a little off, some missing, some twice, some where nothing is."""
    of = lambda c: F.col(f"l_{c}")
    x, y, c = of("quantity"), of("discount") * 100, F.round("l_extendedprice") % 700 / 1000.0
    rows = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), of("orderkey").cast("string")).alias("path"), (of("partkey") % 3).cast("int").alias("cls"), ((of("partkey") * 10000 + of("suppkey")) * 10 + of("linenumber")).alias("box_no"), of("partkey").alias("k"), of("suppkey").alias("s"), x.alias("x"), y.alias("y"), c.alias("c"))
    box = lambda x1, y1, x2, y2: [F.expr(e).alias(n) for e, n in ((x1, "x1"), (y1, "y1"), (x2, "x2"), (y2, "y2"))]
    truth = rows.select("path", "cls", "box_no", *box("x", "y", "x + 30", "y + 20"))
    near = rows.where("k % 5 != 0").select("path", "cls", "box_no", *box("x + s % 9", "y + k % 4", "x + 30 + s % 5", "y + 20"), (0.3 + F.col("c")).alias("conf"))
    far = F.when(F.col("s") % 2 == 0, 0).otherwise(300)
    more = rows.where("s % 4 < 2").withColumn("far", far).select("path", "cls", (-F.col("box_no")).alias("box_no"), *box("x + if(far = 0, 3, far)", "y", "x + 33 + far", "y + 19"), (0.25 + F.col("c") / 2).alias("conf"))
    return truth, near.unionByName(more)


@query("detection_by_class", f"""WITH {CURVES} SELECT cls, level, n_truth, n_found, "right", round(ap, 6) AS ap, round(top.p, 6) AS precision, round(top.r, 6) AS recall FROM r""")
def detection_by_class(spark, sf_dir):
    """Average precision of each class at ten overlaps, and precision and recall where F1 is greatest."""
    out = detection.by_class(*_boxes(spark, sf_dir))
    return out.select("cls", "level", "n_truth", "n_found", "right", *[F.round(c, 6).alias(c) for c in ("ap", "precision", "recall")])


@query("detection_summary", f"""WITH {CURVES} SELECT round(avg(ap) FILTER (WHERE level = 0.5), 6) AS map50, round(avg(ap), 6) AS map50_95, round(avg(top.p) FILTER (WHERE level = 0.5), 6) AS precision, round(avg(top.r) FILTER (WHERE level = 0.5), 6) AS recall FROM r""")
def detection_summary(spark, sf_dir):
    """Mean average precision at an overlap of 0.5 and over ten overlaps, mean precision and recall."""
    _, out = detection.evaluated(*_boxes(spark, sf_dir))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])
