import io
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.sources import readers, sinks

ROWS = [("val", "A b", "s1", "1", "1", "x/1_line_001.png", 'say "ñ",\nthen', "0", "0", ""), ("train", "A b", "s1", "1", "2", "x/1_line_002.png", "", "1", "1", ""), ("Train ", "C", "s2", "2left", "1", " x/2.png ", "text", "1", "2", "")]


def test_csv_round_trip_and_manifest_rules(spark, tmp_path):
    df = spark.createDataFrame(ROWS, readers.MANIFEST)
    sinks.write_csv(df, f"{tmp_path}/m")
    back = readers.csv(spark, f"{tmp_path}/m")
    assert sorted(map(tuple, back.collect())) == sorted(ROWS)
    assert [r.image_path for r in readers.manifest(spark, f"{tmp_path}/m", "train").collect()] == ["x/2.png"]
    more = spark.createDataFrame([("val", "s", "s1", str(p), str(n), f"{p}_{n}.png", "t", "0", "0", "") for p in (10, 2) for n in (11, 9)], readers.MANIFEST)
    sinks.write_csv(more.repartition(4), f"{tmp_path}/o")
    assert {r.image_path for r in readers.manifest(spark, f"{tmp_path}/o", limit=3).collect()} == {"2_9.png", "2_11.png", "10_9.png"}
    with pytest.raises(ValueError, match="no rows"):
        readers.manifest(spark, f"{tmp_path}/m", "test")
    sinks.write_csv(df.drop("page"), f"{tmp_path}/n")
    with pytest.raises(ValueError, match="lacks page"):
        readers.manifest(spark, f"{tmp_path}/n")


def test_padded_and_marked_headers(spark, tmp_path):
    (tmp_path / "t.csv").write_text("﻿ epoch , loss\n1,0.5\n", encoding="utf-8")
    assert [tuple(r) for r in readers.csv(spark, f"{tmp_path}/t.csv", infer=True).select("epoch", "loss").collect()] == [(1, 0.5)]


def test_sinks_by_source_and_split(spark, tmp_path):
    df = spark.createDataFrame(ROWS, readers.MANIFEST)
    sinks.write_by_source(df, f"{tmp_path}/s", "source")
    assert {p.name for p in (tmp_path / "s").iterdir() if p.is_dir()} == {"folder=A_b", "folder=C"}
    sinks.write_everywhere(df, [f"{tmp_path}/a", f"{tmp_path}/b"])
    assert readers.csv(spark, f"{tmp_path}/a").count() == readers.csv(spark, f"{tmp_path}/b").count() == 3
    sinks.write_json(df.where("split = 'val'").select("ground_truth_text"), f"{tmp_path}/j")
    assert any('\n  "ground_truth_text"' in p.read_text(encoding="utf-8") for p in (tmp_path / "j").glob("part-*"))
    assert "ñ" in "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "j").glob("part-*"))
    assert readers.json_document(spark, f"{tmp_path}/j", "ground_truth_text string").first()[0] == ROWS[0][6]


def test_files_crops_images_and_sidecars(spark, tmp_path):
    grey = np.arange(120, dtype=np.uint8).reshape(10, 12)
    for name in ("3_line_013.png", "3_line_013.1.png", "3_line_2.PNG", "notes.txt"):
        (tmp_path / name).write_bytes(readers.encode_png(grey))
    listing = readers.files(spark, str(tmp_path), "*", content=True)
    assert sorted((r.page, r.line, r.sub) for r in readers.crops(listing, variants=False).collect()) == [("3", 2, None), ("3", 13, None)]
    assert readers.crops(listing).where("sub = 1").count() == 1
    images = readers.grey_images(listing).collect()
    assert len(images) == 4 and bytes(images[0].px) == grey.tobytes()
    with pytest.raises(FileNotFoundError):
        readers.files(spark, str(tmp_path), "*.pdf")
    rows = spark.createDataFrame([("s1", "3", "7", "2", "t")], "source_id string, page string, line string, aug_id string, text string")
    named = sinks.sidecar_names(rows).select(F.concat("stem", F.lit(".gt.txt")).alias("name"), "text")
    assert [r.path for r in sinks.write_files(named, "name", "text", f"file://{tmp_path}/out").collect()] == [f"file://{tmp_path}/out/s1_p3_l007_aug02.gt.txt"]
    assert (tmp_path / "out" / "s1_p3_l007_aug02.gt.txt").read_text() == "t"
    with pytest.raises(ValueError, match="no scheme"):
        sinks.open_shared(str(tmp_path / "x"))
    kept = sinks.backup(spark, f"{tmp_path}/out")
    assert kept.startswith(f"{tmp_path}/out_backup_") and readers.files(spark, kept).count() == 1 and sinks.backup(spark, f"{tmp_path}/none") is None
    assert readers.first_existing(spark, [f"{tmp_path}/none", str(tmp_path)]) == str(tmp_path)


def filtered_png(rgb, kinds):
    """A PNG of colours whose rows are filtered in the given ways, byte by byte as the format says."""
    h, w, per = rgb.shape
    raw = b""
    for y in range(h):
        raw += bytes([kinds[y]])
        for i in range(w * per):
            at = lambda y, i: int(rgb[y, i // per, i % per]) if y >= 0 and i >= 0 else 0
            a, b, c = at(y, i - per), at(y - 1, i), at(y - 1, i - per)
            p = a + b - c
            guess = [0, a, b, (a + b) // 2, min((a, b, c), key=lambda v: (abs(p - v), [a, b, c].index(v)))][kinds[y]]
            raw += bytes([(at(y, i) - guess) % 256])
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def test_png_rows_of_every_filter():
    rgb = np.random.default_rng(4).integers(0, 256, (15, 9, 3)).astype(np.uint8)
    want = np.rint(rgb.astype(float) @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)
    assert (readers.decode_png(filtered_png(rgb, [0, 1, 2, 3, 4] * 3)) == want).all()
    assert readers.decode_png(filtered_png(rgb, [0] * 15).replace(b"IDAT", b"IDAX")) is None


def test_labelled_images_and_compiled_tables(spark, tmp_path):
    images = spark.createDataFrame([("a/x.png", b"1"), ("a/y.png", b"2")], "path string, content binary")
    labels = spark.createDataFrame([("b/x.txt",), ("b/z.txt",)], "path string")
    assert [r.path for r in readers.labelled(images, labels).collect()] == ["a/x.png"]
    rows = spark.createDataFrame([("a/x.png", "t", 1), ("a/q.png", "u", 2)], "image_path string, ground_truth_text string, n int")
    sinks.write_compiled(rows, images, f"{tmp_path}/c")
    assert [(r.image_path, r.ground_truth_text, bytes(r.content)) for r in spark.read.parquet(f"{tmp_path}/c").collect()] == [("a/x.png", "t", b"1")]


def test_transcripts(spark, tmp_path):
    (tmp_path / "a.txt").write_text("﻿one\n\n \t\ntwo \r\nthree", encoding="utf-8")
    texts = readers.whole_texts(spark, str(tmp_path))
    assert [(r.line_no, r.line) for r in readers.transcript_lines(texts, ["path"]).orderBy("line_no").collect()] == [(1, "one"), (2, "two"), (3, "three")]
    held = io.BytesIO()
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:p><w:r><w:t>on</w:t></w:r><w:r><w:t>e</w:t></w:r></w:p><w:p/><w:p><w:t>two</w:t></w:p></w:document>")
    assert readers.docx_lines(held.getvalue()) == ["one", "two"]
    pages = readers.pages_of(spark.createDataFrame([(1, b"ab")], "source_no long, content binary"), lambda data: [data[i : i + 1] for i in range(len(data))])
    assert [(r.page_no, bytes(r.content)) for r in pages.collect()] == [(1, b"a"), (2, b"b")]


def test_label_boxes_and_missing_files(spark):
    boxes = readers.label_boxes(spark.createDataFrame([("p", "0 0.5 0.5 0.1 0.2\n\n1 0.1 0.1 0.1 0.1\n")], "path string, text string"))
    assert [(r["cls"], r.h) for r in boxes.orderBy("box_no").collect()] == [(0, 0.2), (1, 0.1)]
    rows = spark.createDataFrame([("a.png", "t"), ("b.png", "t"), ("c.png", None)], "image_path string, ground_truth_text string")
    listing = spark.createDataFrame([("a.png",)], "path string")
    assert [r.image_path for r in readers.aligned(rows, listing).collect()] == ["a.png"]
    assert sorted(r.image_path for r in readers.missing(rows, listing).collect()) == ["b.png", "c.png"]


def test_many_small_files_make_few_tasks(spark, tmp_path):
    for k in range(300):
        (tmp_path / f"f {k}.bin").write_bytes(bytes([k % 256]) * (k + 1))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        found = readers.files(spark, str(tmp_path), "*.bin", content=True)
        assert found.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism < 300
        assert {(r.name, bytes(r.content)) for r in found.collect()} == {(p.name, p.read_bytes()) for p in tmp_path.iterdir()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
