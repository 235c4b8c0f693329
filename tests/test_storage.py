"""Files in storage by a listing that tasks make."""

import pytest
from pyspark.sql import functions as F

from foliate.sources import files
from tests.test_blocks import BODY, make_docx, plan_of


@pytest.fixture
def corpus(tmp_path):
    names = {"a/1": make_docx(BODY), "a/2": b"", "a/3 +%": b"x" * 9000, "b/c/d/4": b"no archive", "b/é/5": make_docx(BODY), "b/_no/6": b"x", "b/.no/7": b"x"}
    for name, content in names.items():
        folder = tmp_path / "templates" / name
        folder.mkdir(parents=True)
        (folder / "source.docx").write_bytes(content)
        (folder / "other.txt").write_bytes(b"x")
    return str(tmp_path)


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def test_listing_is_that_of_a_scan_and_of_empty_files(spark, corpus):
    shown = files.scan(spark, corpus).select("path", "length").unionByName(files.empty_files(spark, corpus))
    assert rows_of(files.listing(spark, corpus), "path", "length") == rows_of(shown, "path", "length")
    assert rows_of(files.listing(spark, "file://" + corpus, "s*[r-t]ce.do?x"), "path", "length") == rows_of(shown, "path", "length")


def test_gate_by_listing(spark, corpus, tmp_path):
    columns = ("path", "length", "error_type")
    gate = files.gated_scan(spark, corpus, limit=8000, listed=files.listing(spark, corpus))
    assert rows_of(gate, *columns) == rows_of(files.gated_scan(spark, corpus, limit=8000), *columns)
    good = files.accepted_files(spark, corpus, gate, limit=8000)
    names = [F.col("path").isin([r["path"] for r in gate.filter("error_type IS NULL").collect()])]
    assert rows_of(good, "path", "modificationTime", "length", "content") == rows_of(files.scan(spark, corpus).filter(*names), "path", "modificationTime", "length", "content")
    assert good.count() == 2


def test_no_name_comes_to_the_driver(spark, corpus):
    gate = files.gated_scan(spark, corpus, limit=8000, listed=files.listing(spark, corpus))
    for rows in (gate, files.accepted_files(spark, corpus, gate, limit=8000)):
        assert "binaryFile" not in plan_of(rows) and "LocalTableScan" not in plan_of(rows)


def test_empty_folder(spark, tmp_path):
    listed = files.listing(spark, str(tmp_path))
    assert files.gated_scan(spark, str(tmp_path), listed=listed).count() == 0
