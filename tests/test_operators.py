import pandas as pd
import pytest
from pyspark.sql import functions as F

from quire.operators import align, boxes, infer, quality, split
from quire.operators.order import numbered


def test_numbering_has_no_gaps_whatever_the_partitions(spark):
    df = spark.range(0, 997).select((F.col("id") % 3).alias("g"), F.col("id")).repartition(7)
    rows = numbered(df, ["g"], [F.col("id").desc()], total="n").collect()
    for g in range(3):
        mine = sorted((r.pos, -r.id) for r in rows if r.g == g)
        assert [p for p, _ in mine] == list(range(1, len(mine) + 1)) and mine == sorted(mine, key=lambda x: x[1])
        assert {r.n for r in rows if r.g == g} == {len(mine)}
    assert numbered(df.where("false"), ["g"], [F.col("id")]).count() == 0


def test_numbering_keeps_null_groups_apart(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 1)], "g string, x int")
    assert sorted((r.g or "", r.x, r.pos) for r in numbered(df, ["g"], [F.col("x")]).collect()) == [("", 1, 1), ("", 2, 2), ("a", 1, 1)]


def test_alignment_has_as_many_rows_as_the_longer_side(spark):
    left = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 0), (None, 0)], "k string, l int")
    right = spark.createDataFrame([("a", i) for i in range(3)] + [("c", 0), ("c", 1), (None, 0)], "k string, r int")
    out = align.align(left, right, ["k"], [F.col("l")], [F.col("r")])
    found = {(r.k, r.pos): (r.l, r.r, r.status) for r in out.collect()}
    assert len(found) == 5 + 1 + 2 + 1
    assert found["a", 3] == (2, 2, "aligned") and found["a", 5] == (4, None, "excess_left") and found["c", 2] == (None, 1, "excess_right") and found[None, 1][2] == "aligned"
    summary = {r.k: (r.left_rows, r.right_rows, r.aligned_rows, r["diff"]) for r in align.summary(out, ["k"]).collect()}
    assert summary["a"] == (5, 3, 3, 2) and summary["c"] == (0, 2, 0, -2)
    assert align.unresolved(out).count() == 5


def test_stratified_split_sizes_and_determinism(spark):
    sizes = {"one": 1, "two": 2, "five": 5, "many": 33}
    df = spark.createDataFrame([(s, f"{s}{i}") for s, n in sizes.items() for i in range(n)], "s string, k string")
    out = split.stratified(df, ["s"], "k")
    train = {r.s: r["count"] for r in out.where("split = 'train'").groupBy("s").count().collect()}
    assert train == {"one": 1, "two": 1, "five": 4, "many": 26}
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, split.stratified(df.repartition(3), ["s"], "k").collect()))


def test_group_split_and_replication(spark):
    df = spark.createDataFrame([(f"s{i % 4}", i) for i in range(40)] + [(None, 99)], "s string, i int")
    out = split.by_group(df, "s", 2)
    by = {r.s: r.splits for r in out.groupBy("s").agg(F.collect_set("split").alias("splits")).collect()}
    assert all(len(v) == 1 for v in by.values()) and sum(v == ["val"] for v in by.values()) == 2
    copies = split.replicate(out, 5)
    assert copies.where("split = 'val' and is_augmented").count() == 0
    assert copies.where("split = 'train'").count() == 5 * out.where("split = 'train'").count()


def test_batches_fall_back_to_the_input(spark):
    df = spark.range(8).select(F.col("id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("t"))
    batches = infer.batched(df, [F.col("id")], 3)

    def call(texts):
        if "t0" in texts:
            return texts[:1]  # a wrong length
        if "t3" in texts:
            raise ValueError("no model")
        return [t.upper() for t in texts]

    got = {r.id: r.corrected for r in infer.corrected(batches, "t", call, attempts=2, sleep=lambda s: None).collect()}
    assert got == {i: f"t{i}" for i in range(6)} | {6: "T6", 7: "T7"}
    one = infer.corrected(batches.repartition(1), "t", lambda texts: [f"{len(texts)}{t}" for t in texts])
    assert {r.id: r.corrected for r in one.collect()} == {i: f"{2 if i > 5 else 3}t{i}" for i in range(8)}
    replies = infer.to_messages(batches, "t")
    assert infer.from_messages(replies).count() == 8
    assert infer.from_messages(replies.withColumn("payload", F.lit('["x"]'))).count() == 0


def test_manifest_of_boxes(spark):
    json = '{"s": {"p1": {"path": "a.png", "boxes": [[5,1,9,4,0.9],[1,1,2,2,0.1]]}, "p2": {"path": "b.png", "boxes": []}}}'
    rows = boxes.manifest_rows(spark.createDataFrame([(json,)], "j string"), "j").collect()
    assert [(r.source, r.page, r.box_no, r.x1, r.conf) for r in rows] == [("s", "p1", 0, 5.0, 0.9)]
    df = spark.createDataFrame([("p", 1), ("q", 1), ("q", 2), ("r", 1), ("r", 2), ("r", 3)], "page string, x int")
    assert [r.suffix for r in boxes.region_names(df, ["page"], [F.col("x")]).orderBy("page", "x").collect()] == ["full", "left", "right", "col1", "col2", "col3"]


def test_quality(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), (None, 1), (None, 0), (" ", 1)], "t string, ok int")
    assert tuple(quality.counters(df, "t", F.col("ok") == 1).first()) == (5, 2, 1, 2, 1)
    values = spark.createDataFrame([(x,) for x in (0.0, 0.012, 0.49, 0.5, 7.0, -1.0)], "v double")
    assert {r.bin: r.n for r in quality.histogram(values, "v", 0.0, 0.5, 40).collect()} == {1: 3, 40: 3}
    runs = spark.createDataFrame([("r", i, v) for i, v in enumerate([5.0, 4.0, 6.0, 6.0, 6.0, 1.0])], "run string, i int, v double")
    assert tuple(quality.early_stop(runs, "run", ["i"], "v", 3).first()) == ("r", 2, 4.0, 5)
    assert tuple(quality.early_stop(runs, "run", ["i"], "v", 9).first()) == ("r", 6, 1.0, None)


class Refused(Exception):
    def __init__(self, code):
        self.code = code


def test_retries_wait_as_the_error_says():
    waits, replies = [], iter([Refused(429), Refused(429), Refused(500), ["x"], ["A", "B"]])

    def call(texts):
        reply = next(replies)
        if isinstance(reply, Exception):
            raise reply
        return reply

    assert infer.answered(["a", "b"], call, sleep=waits.append) == ["A", "B"] and waits == [11, 12, 5]
    waits.clear()
    assert infer.answered(["a"], infer.by_json(lambda message: "no json"), attempts=2, sleep=waits.append) == ["a"] and waits == [5, 5]
    assert infer.answered(["é", "b"], infer.by_json(str.upper)) == ["É", "B"]


def test_overlap_of_pages(spark):
    left, right = (spark.createDataFrame(rows, "s string, p long") for rows in ([("a", 1), ("a", 1), ("b", 2), (None, 3)], [("x", 1), ("x", 3), ("x", 9)]))
    assert sorted(r.p for r in align.overlap(left, right, ["p"]).collect()) == [1, 3]


def test_catalog_has_sql_for_all_but_images_and_long_word_distances():
    from quire.plans import catalog

    assert set(catalog.queries()) - set(catalog.oracle_sql()) == {"page_images", "page_lines", "wer_whole_lines"} and set(catalog.oracle_sql()) <= set(catalog.queries())


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert rows and 0 < rows[0].cer < 1


@pytest.mark.parametrize("name", ["align_full_outer", "early_stop", "seam_dp", "natural_sort_rank", "chrf_corpus", "stratified_split", "valley_argmin", "otsu_threshold", "near_copy_cer", "csv_roundtrip", "manifest_limit", "transcript_files", "image_files", "backup_rows", "label_boxes", "closing_round", "detected_regions"])
def test_queries_agree_with_sql(spark, sf_dir, name):
    import duckdb

    from quire.plans import catalog

    con = duckdb.connect()
    for t in ("documents", "embeddings", "events", "pages", "nation", "region", "lineitem"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got, want = catalog.queries()[name](spark, sf_dir).toPandas(), con.execute(catalog.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert _close(got[columns], want[columns])


def _close(a, b):
    """The same rows, floats to six digits; an integer column may have come as floats because of nulls."""

    def shown(x):
        if x is None or x is pd.NA or x != x:
            return ""
        return f"{x:.6g}" if isinstance(x, int | float) and not isinstance(x, bool) else str(x)

    key = lambda df: sorted(tuple(map(shown, r)) for r in df.astype(object).itertuples(index=False, name=None))
    return key(a) == key(b)
