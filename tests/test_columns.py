from pyspark.sql import functions as F

from quire.operators import columns


def test_columns(spark):
    df = spark.createDataFrame([(1, None, 0.5)], "`train/box_loss` int, status string, `metrics/mAP50` double")
    assert columns.containing(df, "loss", "mAP") == ["train/box_loss", "metrics/mAP50"]
    assert columns.without(df, "status", "none").columns == ["train/box_loss", "metrics/mAP50"]
    assert columns.filled(df, status="aligned", page="N/A").select("status", "page").first() == ("aligned", "N/A")
    assert columns.complete(df, "status").count() == 0 and columns.with_constants(df, split="val").first().split == "val"
    row = spark.range(1).select(columns.log_mentions(F.lit("CUDA out of memory"), "out of memory", "killed").alias("a"), columns.log_mentions(F.lit(None).cast("string"), "x").alias("b")).first()
    assert tuple(row) == (True, False)
    assert columns.ladder([16, 8, 4], lambda n: n if n < 10 else None) == (8, 8) and columns.ladder([1], lambda n: None) is None
