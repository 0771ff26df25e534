import pytest

from quire.plans import workflow
from quire.sources import readers


def test_files_are_read_by_the_paths_of_a_table(spark, tmp_path):
    held = {f"file://{tmp_path}/a b%{k}+é.bin": bytes([k]) * 300 for k in range(5)}
    for path, data in held.items():
        (tmp_path / path.rsplit("/", 1)[1]).write_bytes(data)
    (tmp_path / "empty").write_bytes(b"")
    held[f"file://{tmp_path}/empty"] = b""
    rows = spark.createDataFrame([(p,) for p in [*held, f"file://{tmp_path}/none", None]], "at string").coalesce(1)
    assert {r.path: bytes(r.content) for r in readers.contents(rows, "at").collect()} == held


@pytest.mark.parametrize("name", ["dataset_pairs"])
def test_no_folder_is_listed_by_the_driver(spark, sf_dir, monkeypatch, name):
    """A listing holds every file's status in the driver."""

    def listing(*a, **b):
        raise AssertionError("listed")

    monkeypatch.setattr(readers, "files", listing)
    monkeypatch.setattr(readers, "whole_texts", listing)
    found = workflow.QUERIES[name](spark, sf_dir)
    assert {r.files for r in found.select("files").distinct().collect()} == {2} and found.count() > 500
