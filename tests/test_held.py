"""What a task holds in Python does not grow with its batch."""

import pyarrow as pa

from foliate.operators import materialise as D
from foliate.plans import nesting
from foliate.sources import docx
from tests.test_blocks import BODY, make_docx


class Rows:
    """Stands for a table: keeps the function that its batches would go through."""

    def __init__(self, *batches):
        self.batches, self.sizes = batches, []

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        self.sizes = [b.num_rows for b in run(iter(self.batches))]
        raise StopIteration

    mapInPandas = mapInArrow


def test_elements_leave_in_small_batches(spark, monkeypatch):
    monkeypatch.setattr(docx, "HELD", 2000)
    content = make_docx(BODY)
    rows = Rows(pa.record_batch({"key": [str(i) for i in range(50)], "content": [content] * 50}))
    try:
        docx.elements(rows)
    except StopIteration:
        pass
    one = len(list(docx._elements(content)))
    assert sum(rows.sizes) == 50 * one and 50 * one > max(rows.sizes) and len(rows.sizes) > 10


def test_files_are_made_a_few_at_a_time(spark, monkeypatch, tmp_path):
    made = []
    monkeypatch.setattr(nesting, "_FILES", 10)
    spark.range(100).withColumnRenamed("id", "doc_id").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")

    class Table:
        def select(self, *_):
            return self

        def mapInPandas(self, run, schema):
            import pandas as pd

            made.extend(len(x) for x in run(iter([pd.DataFrame({"doc_id": range(95)})])))

    monkeypatch.setattr(nesting.T, "table", lambda *_: Table())
    nesting._packed(spark, str(tmp_path), nesting._headed)
    assert made == [10] * 9 + [5]


def test_missing_texts_by_small_batches(spark, monkeypatch):
    monkeypatch.setattr(D, "HELD", 3)
    want = spark.createDataFrame([(k, f"text {k} {i}") for k in range(40) for i in range(3)] + [(99, "same")], "k int, text string")
    shown = spark.createDataFrame([(k, f"text {k} 1 and more") for k in range(40)] + [(99, "same")], "k int, text string")
    got = {r["k"]: r["texts"] for r in D.missing_texts(want, shown, "k").collect()}
    assert got == {k: [f"text {k} 0", f"text {k} 2"] for k in range(40)}
