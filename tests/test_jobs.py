import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.functions.edits import sequence_distance
from quire.jobs import correction, curation, dataset, evaluation, regions
from quire.sources import readers, sinks

LETTERS = {"A": ["2right_line_001", "2left_line_003", "2left_line_003.1", "2left_line_010", "10_line_001", "cover_line_002", "9_line_007"], "B": ["1_line_001"], "D": ["1_line_002", "1_line_001"]}
SAID = {"A": "﻿ one\ttwo \n\n  three\r\nfour\n five\nsix", "C": "nothing here", "D": "a\nb\n \nc\nd é"}
ORDER = {"A": ["2right.png", "2left"], "D": []}


def png(seed):
    return readers.encode_png(np.random.default_rng(seed).integers(0, 255, (12, 20)).astype(np.uint8))


@pytest.fixture
def folders(spark, tmp_path):
    for source, names in LETTERS.items():
        (tmp_path / "crops" / source).mkdir(parents=True)
        for k, name in enumerate(names):
            (tmp_path / "crops" / source / f"{name}.png").write_bytes(png(k))
    (tmp_path / "crops" / "A" / "cover.png").write_bytes(b"")
    (tmp_path / "said").mkdir()
    for source, said in SAID.items():
        (tmp_path / "said" / f"{source} text.txt").write_text(said, encoding="utf-8")
    config = spark.createDataFrame([(s, f"id{s}", f"{s} text.txt", ORDER.get(s)) for s in "ABCDE"], curation.CONFIG)
    return f"file://{tmp_path}/crops", f"file://{tmp_path}/said", config, f"file://{tmp_path}/out"


def test_curation(spark, folders):
    crops, said, config, out = folders
    found = curation.curate(spark, crops, said, config, out)
    rows = {s: [(r.page, r.line, r.image_path.rsplit("/", 1)[-1].removesuffix(".png"), r.ground_truth_text, r.status.split("_")[-1]) for r in found.rows.where(F.col("source") == s).orderBy("line").collect()] for s in "ABCDE"}
    order = ["2right_line_001", "2left_line_003.1", "2left_line_003", "2left_line_010", "9_line_007", "10_line_001", "cover_line_002"]
    lines = ["one two", "three", "four", "five", "six"]
    assert rows["A"] == [(n.split("_")[0], k + 1, n, lines[k] if k < 5 else "", "aligned" if k < 5 else "image") for k, n in enumerate(order)]
    assert rows["D"] == [("1", 1, "1_line_001", "a", "aligned"), ("1", 2, "1_line_002", "b", "aligned"), ("N/A", 3, "", "c", "transcript"), ("N/A", 4, "", "d é", "transcript")]
    assert not rows["B"] and not rows["C"] and not rows["E"]
    assert {tuple(r) for r in found.skipped.collect()} == {("B", "transcript"), ("C", "crops"), ("E", "crops"), ("E", "transcript")}
    assert {tuple(r) for r in found.summary.collect()} == {("A", "idA", 7, 5, 5, 2), ("D", "idD", 2, 4, 2, -2)}
    assert {tuple(r)[:4] for r in found.unresolved.where("source = 'D'").collect()} == {("excess_transcript", "D", None, 3), ("excess_transcript", "D", None, 4)}
    assert tuple(found.qa.first()) == (7, 0, 0, 0, 0)
    back = readers.csv(spark, f"{out}/rows")
    assert back.columns == curation.FIELDS and back.count() == 11
    kept = curation.write(found, out, keep_status=False)
    assert readers.csv(spark, kept).count() == 11 and readers.csv(spark, f"{out}/rows").columns == curation.FIELDS[:-1]
    assert {r.folder for r in readers.csv(spark, f"{out}/by_source").select("folder").distinct().collect()} == {"idA", "idD"}
    by_page = curation.curated(readers.files(spark, crops, "*.png", recursive=True), readers.whole_texts(spark, said), config, variants=False, by_page=True).rows
    assert [(r.page, r.line) for r in by_page.where("source = 'A' and image_path != ''").orderBy(F.length("page"), "page", "line").collect()] == [("9", 1), ("10", 1), ("2left", 1), ("2left", 2), ("cover", 1), ("2right", 1)]


def test_crops_are_copied_under_their_numbers(spark, folders, tmp_path):
    crops, _, config, out = folders
    curation.renamed(spark, crops, config, out)
    names = sorted(p.name for p in (tmp_path / "out" / "A").iterdir() if p.suffix == ".png")
    assert names == ["10_line_001.png", "2left_line_001.png", "2left_line_002.png", "2left_line_003.png", "2right_line_001.png", "9_line_001.png", "cover_line_001.png"]
    assert (tmp_path / "out" / "A" / "2left_line_001.png").read_bytes() == (tmp_path / "crops" / "A" / "2left_line_003.1.png").read_bytes()


def test_dataset_and_pairs(spark, tmp_path):
    rows, files = [], []
    for k in range(12):
        path = f"file:///in/s{k % 4}/l{k}.png"
        rows.append((f"S {k % 4}", f"s{k % 4}", "1", str(k), path, " " if k == 5 else f"﻿t {k}", "" if k % 2 else "aligned"))
        if k != 7:
            files.append((path.replace(":///", ":/"), b"broken" if k == 8 else png(k)))
    df = spark.createDataFrame(rows, "source string, source_id string, page string, line string, image_path string, ground_truth_text string, status string").repartition(3)
    images = spark.createDataFrame(files, "path string, content binary").repartition(2)
    made = {}
    for run in ("a", "b"):
        out = f"file://{tmp_path}/{run}"
        manifest = dataset.prepare(df, images, out, copies=2, sources=1)
        held = manifest.collect()
        made[run] = {p.relative_to(tmp_path / run): p.read_bytes() for p in (tmp_path / run).rglob("*.png")}
        assert {r.image_path for r in held} == {f"{out}/{p}" for p in made[run]}
    assert made["a"] == made["b"]
    val = {r.source_id for r in held if r.split == "val"}
    usable = [k for k in range(12) if k not in (5, 7) and (k != 8 or f"s{k % 4}" in val)]
    assert len(val) == 1 and {(int(r.line), r.aug_id) for r in held} == {(k, a) for k in usable for a in (["0"] if f"s{k % 4}" in val else ["1", "2"])}
    for r in held:
        own = dict(files)[r.orig_image_path.replace(":///", ":/")]
        data = made["b"][next(p for p in made["b"] if r.image_path.endswith(str(p)))]
        assert (data == own) == (r.split == "val") and r.is_augmented == str(int(r.split == "train"))
    back = readers.csv(spark, f"{out}/manifests")
    assert back.count() == len(held) and {r.split for r in back.select("split").distinct().collect()} == {"train", "val"}
    kept = readers.files(spark, f"{out}/*/images", "*.png", recursive=True, content=True).where("not path like '%aug_02%'")
    dataset.write_pairs(manifest, kept, f"{out}/pairs")
    stems = {(r.split, f"{r.source_id}_p1_l{int(r.line):03d}" + ("_aug01" if r.aug_id == "1" else "")) for r in held if r.aug_id != "2"}
    assert {(p.parent.name, p.name.removesuffix(".gt.txt")) for p in (tmp_path / "b" / "pairs").rglob("*.gt.txt")} == stems
    assert all("﻿" not in p.read_text(encoding="utf-8") for p in (tmp_path / "b" / "pairs").rglob("*.gt.txt"))
    assert spark.read.text(f"{out}/pairs/missing").count() == sum(r.aug_id == "2" for r in held)
    with pytest.raises(ValueError, match="no aligned"):
        dataset.prepare(df.limit(0), images, out)


def rates(pairs):
    c = [(sequence_distance(r, h), max(1, len(r))) for r, h in pairs]
    w = [(sequence_distance(r.split(), h.split()), max(1, len(r.split()))) for r, h in pairs]
    return [sum(x[0] for x in v) / sum(x[1] for x in v) for v in (c, w)]


def test_evaluation(spark, tmp_path):
    texts = {"s1": ["one two", "", "niño"], "s2": ["three four five"]}
    rows = [(s, s, "1", str(k), f"/in/{s}_{k}.png", t) for s, said in texts.items() for k, t in enumerate(said)] + [("s2", "s2", "1", "9", "/in/none.png", "no file at all")]
    df = spark.createDataFrame(rows, "source string, source_id string, page string, line string, image_path string, ground_truth_text string")
    images = spark.createDataFrame([(r[4], readers.encode_png(np.full((4, 4), len(r[5]), np.uint8))) for r in rows[:-1]], "path string, content binary")
    by_length = {len(r[5]): r[5] for r in rows}
    worse = lambda greys: [by_length[int(g[0, 0])].replace("o", "0") for g in greys]
    better = lambda greys: [f"  {by_length[int(g[0, 0])].replace('wo', 'w')}\n" for g in greys]
    first = evaluation.written(evaluation.predictions(df, images, worse), f"file://{tmp_path}/a", "first", {"beams": F.lit(4)}, f"file://{tmp_path}/nothing").first()
    assert first.phase == "first" and first.beams == 4 and first.overall.num_samples == 4 and set(first.per_source) == {"s1", "s2"}
    pairs = [(t, t.replace("o", "0")) for said in texts.values() for t in said]
    assert np.allclose([first.overall.CER, first.overall.WER], rates(pairs))
    assert np.allclose([first.per_source["s1"].CER, first.per_source["s1"].WER], rates(pairs[:3]))
    assert first.comparison.baseline.CER is None and first.comparison.improvement.chrF_delta is None and first.comparison.current.CER == first.overall.CER
    second = evaluation.written(evaluation.predictions(df, images, better), f"file://{tmp_path}/b", "second", None, f"file://{tmp_path}/a/metrics").first()
    assert second.comparison.baseline.WER == first.overall.WER
    assert abs(second.comparison.improvement.CER_delta - (first.overall.CER - second.overall.CER)) < 1e-12 and second.comparison.improvement.chrF_delta > 0
    raw = "".join(p.read_text(encoding="utf-8") for p in sorted((tmp_path / "b" / "metrics").glob("part-*")))
    assert json.loads(raw)["outputs"]["predictions"] == f"file://{tmp_path}/b/predictions"
    assert readers.csv(spark, f"file://{tmp_path}/b/predictions").columns == evaluation.FIELDS
    sinks.write_csv(df.withColumns({"split": F.lit("val"), "image_path": F.concat(F.lit(f"file://{tmp_path}"), "image_path")}), f"{tmp_path}/m")
    (tmp_path / "in").mkdir()
    for r in rows[:-1]:
        (tmp_path / r[4][1:]).write_bytes(readers.encode_png(np.full((4, 4), len(r[5]), np.uint8)))
    whole = evaluation.evaluate(spark, f"{tmp_path}/m", f"file://{tmp_path}/in", better, f"file://{tmp_path}/c", "third").first()
    assert whole.overall.num_samples == 3 and whole.per_source["s2"].CER == 0  # a row without a text is not in a manifest


def test_stages(spark, tmp_path):
    rows = [(2, "third", 0.1, 0.3, 0.9), (0, "first", 0.4, 0.5, 0.5), (1, "second", 0.2, 0.6, 0.5)]
    got = evaluation.compared(spark.createDataFrame(rows, "place int, stage string, CER double, WER double, chrF double")).orderBy("place").collect()
    assert [r.CER_delta for r in got][0] is None and np.allclose([r.CER_delta for r in got[1:]], [-0.2, -0.1])
    assert got[0].CER_gain is None and np.allclose([r.CER_gain for r in got[1:]], [0.5, 0.75]) and np.allclose([r.chrF_gain for r in got[1:]], [0.0, 0.8])
    zero = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 0.1, 0.1, 0.1)], "place int, CER double, WER double, chrF double")
    assert evaluation.compared(zero).orderBy("place").collect()[1].CER_gain is None


def test_correction(spark, tmp_path):
    said = [("one two three", "onc two thrcc"), ("same", "same"), (" ", "noise"), ("worse", "worse"), ("ñandú q", "ñandu q"), (None, "x"), ("y", None)]
    rows = [(f"p{k:02d}", r, h) for k, (r, h) in enumerate(said)] + [("q", "left as it is", "lcft")]
    df = spark.createDataFrame(rows, "image_path string, ground_truth_text string, prediction string").repartition(3)

    def call(texts):
        if "lcft" in texts:
            raise ValueError
        return [t.replace("c", "e").replace("worse", "vorse") for t in texts]

    out = correction.corrected(df, call, size=5, attempts=2, sleep=lambda s: None)
    lines = {r.image_path: r for r in correction.with_metrics(correction.counted(out)).collect()}
    assert set(lines) == {"p00", "p01", "p02", "p03", "p04", "q"} and lines["p00"].correction == "one two three" and lines["q"].correction == "lcft"
    assert abs(lines["p00"].cer_before - 3 / 13) < 1e-12 and abs(lines["p00"].wer_before - 2 / 3) < 1e-12 and lines["p00"].chrf_after == 1
    assert (lines["p02"].cer_before, lines["p02"].wer_after) == (0, 0) and lines["p03"].cer_after == 0.2
    report = {r.metric: r for r in correction.report(correction.with_metrics(correction.counted(out))).collect()}
    assert [(report["cer"].n, report["cer"].improved, report["cer"].same, report["cer"].worse)] == [(6, 1, 4, 1)]
    assert (report["chrf"].improved, report["chrf"].worse) == (1, 1) and report["cer"].relative_gain > 0
    total = {r.stage: r for r in correction.overall(correction.counted(out)).collect()}
    kept = [(r.ground_truth_text, r.prediction, r.correction) for r in lines.values()]
    for stage, k in (("before", 1), ("after", 2)):
        want = sum(sequence_distance(x[0], x[k]) for x in kept) / sum(len(x[0]) for x in kept)
        assert abs(total[stage].cer - want) < 1e-12
    assert {(r.metric, r.stage): r.n for r in correction.histograms(correction.with_metrics(correction.counted(out))).where("bin = 1").collect()}["cer", "after"] == 3
    sinks.write_csv(df, f"{tmp_path}/p")
    correction.correct(spark, f"{tmp_path}/p", call, f"{tmp_path}/o", size=5, attempts=1)
    assert readers.csv(spark, f"{tmp_path}/o/lines").count() == 8  # a CSV has no nulls, so all rows stay


def halves(grey):
    """A detector: a box for each half of the page that has ink, and one it is not sure of; none on dark pages."""
    h, w = grey.shape
    found = [(x, 0.0, x + w / 2, float(h), 0.9) for x in (w / 2, 0.0) if (grey[:, int(x) : int(x + w / 2)] < 128).any()]
    return [*found, (0.0, 0.0, 1.0, 1.0, 0.1)] if grey.mean() > 50 else []


def test_regions(spark, tmp_path):
    page = np.full((40, 60), 255, np.uint8)
    left, dark = page.copy(), np.zeros((40, 60), np.uint8)
    left[5:9, 3:20] = 0
    both = left.copy()
    both[5:9, 40:50] = 0
    for name, grey in (("S 1/left", left), ("S 1/both", both), ("S 1/blank", page), ("T/left", left), ("T/dark", dark)):
        (tmp_path / "pages" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "pages" / f"{name}.png").write_bytes(readers.encode_png(grey))
    (tmp_path / "pages" / "T" / "broken.png").write_bytes(b"no image")
    out = f"file://{tmp_path}/out"
    found = regions.detect(spark, f"file://{tmp_path}/pages", halves, out)
    rows = {(r.source, r.page, r.box_no): (r.x1, r.x2, r.conf) for r in found.collect()}
    assert rows == {("S 1", "left", 0): (0, 30, 0.9), ("T", "left", 0): (0, 30, 0.9), ("S 1", "both", 0): (30, 60, 0.9), ("S 1", "both", 1): (0, 30, 0.9)}
    documents = {k: v for r in spark.read.text(f"{out}/manifest").collect() for k, v in json.loads(r.value).items()}
    assert {s: set(p) for s, p in documents.items()} == {"S 1": {"left", "both", "blank"}, "T": {"left", "dark", "broken"}} and documents["T"]["dark"]["boxes"] == []
    regions.cut_regions(spark, found, f"file://{tmp_path}/pages", f"{out}/regions", 2)
    cut = {str(p.relative_to(tmp_path / "out" / "regions")): readers.decode_png(p.read_bytes()) for p in (tmp_path / "out" / "regions").rglob("*.png")}
    assert {k: v.shape for k, v in cut.items()} == {"S 1/left_full.png": (40, 32), "T/left_full.png": (40, 32), "S 1/both_left.png": (40, 32), "S 1/both_right.png": (40, 32)}
    assert np.array_equal(cut["S 1/both_right.png"], both[:, 28:])


def read_length(greys):
    """A recogniser, named on the command line below."""
    return [str(g.shape[1]) for g in greys]


def shorter(texts):
    return [t[:-1] for t in texts]


def test_command_line(spark, folders, tmp_path, capsys):
    """The jobs one after the other, each on what the one before it wrote."""
    from quire.__main__ import main

    crops, said, config, out = folders
    config.write.json(f"{out}/config")
    main(["curate", "--crops", crops, "--transcripts", said, "--config", f"{out}/config", "--out", f"{out}/curated"])
    assert "diff_crop_minus_transcript" in capsys.readouterr().out
    main(["dataset", "--rows", f"{out}/curated/rows", "--images", crops, "--out", f"{out}/set", "--copies", "2", "--val-sources", "1"])
    main(["pairs", "--manifest", f"{out}/set/manifests", "--images", f"{out}/set", "--out", f"{out}/pairs"])
    main(["compile", "--manifest", f"{out}/set/manifests", "--images", f"{out}/set", "--out", f"{out}/compiled"])
    held = readers.csv(spark, f"{out}/set/manifests")
    assert held.count() == spark.read.parquet(f"{out}/compiled").count() and held.count() in (2 + 2 * 5, 5 + 2 * 2)
    main(["evaluate", "--manifest", f"{out}/set/manifests", "--images", f"{out}/set", "--recogniser", "tests.test_jobs:read_length", "--out", f"{out}/eval", "--phase", "first"])
    predicted = readers.csv(spark, f"{out}/eval/predictions")
    assert {r.prediction for r in predicted.collect()} == {"20"}
    main(["correct", "--predictions", f"{out}/eval/predictions", "--corrector", "tests.test_jobs:shorter", "--out", f"{out}/corrected"])
    assert {r.correction for r in readers.csv(spark, f"{out}/corrected/lines").collect()} == {"2"}
    main(["rename", "--crops", crops, "--config", f"{out}/config", "--out", f"{out}/renamed"])
    (tmp_path / "pages" / "S").mkdir(parents=True)
    page = np.full((120, 160), 255, np.uint8)
    for top in (20, 60, 100):
        page[top : top + 8, 10:150:3] = 0
    (tmp_path / "pages" / "S" / "p1.png").write_bytes(readers.encode_png(page))
    main(["detect", "--pages", f"file://{tmp_path}/pages", "--detector", "tests.test_jobs:halves", "--out", f"{out}/detected"])
    assert {p.name for p in (tmp_path / "out" / "detected" / "regions" / "S").glob("*.png")} == {"p1_left.png", "p1_right.png"}
    main(["lines", "--pages", f"file://{tmp_path}/pages", "--out", f"{out}/lines"])
    assert sorted(p.name for p in (tmp_path / "out" / "lines" / "S").glob("*.png"))[0] == "p1_line_001.png"
