import math

import duckdb
import numpy as np

from quire.plans import tables


def test_label_restoration_multiplies_in_single_precision(spark, tmp_path):
    near = np.array([k / 100 for k in range(-100, 101)], dtype=np.float32)
    near = np.concatenate([near, np.nextafter(near, np.float32(-2)), np.nextafter(near, np.float32(2))])
    assert any(math.floor(np.float32(x * np.float32(100))) != math.floor(float(x) * 100) for x in near)
    rows = [(k, [float(x)]) for k, x in enumerate(near)] + [(-1, []), (-2, [0.5, -1.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    sql = tables.SQL["label_restoration"].replace("FROM embeddings", f"FROM '{tmp_path}/embeddings.parquet/*.parquet' WHERE len(embedding) > 0")
    found = {r.vec_id: r.total for r in tables.label_restoration(spark, str(tmp_path)).collect()}
    assert found.pop(-1) == 0 and found == dict(duckdb.sql(sql).fetchall())
