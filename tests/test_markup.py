from pyspark.sql import functions as F

from foliate.operators import blocks as B
from foliate.sources import markup


def test_grid():
    assert markup.grid("<table><tr><td>a<td>b</table>") == [["a", "b"]]
    assert markup.grid("<tr><td rowspan=3>a</td><td>b</td></tr><tr><td>c</td></tr><tr></tr>") == [["a", "b"], ["a", "c"], ["a"]]
    assert markup.grid("<tr><td>a</td><td rowspan=2>b</td></tr><tr></tr><tr><td>c</td></tr>") == [["a", "b"], ["", "b"], ["c"]]
    assert markup.grid("<TR><TH COLSPAN=\"2\" rowspan='2'>x</TH><th>y</th></TR><tr><td>z</td></tr>") == [["x", "x", "y"], ["x", "x", "z"]]
    assert markup.grid("<tr><td colspan=0 rowspan=0>a</td><td colspan=99999>b</td></tr>")[0][:3] == ["a", "b", "b"]
    assert len(markup.grid("<tr><td colspan=99999>b</td></tr>")[0]) == markup.MOST_COLUMNS
    assert markup.grid("") == []


def parsed(spark, *pages):
    df = spark.createDataFrame(list(enumerate(pages)), "template_version_id bigint, html string")
    return B.blocks(markup.elements(df)).orderBy("template_version_id", "position").collect()


def test_lists(spark):
    got = parsed(spark, "<ul><li>a<ol><li>b</li></ol></li></ul><ol><li>c</ol><h3>t</h3><ol><li>d</li></ol>")
    assert [r.block_type for r in got] == ["list", "heading", "list"]
    assert [(i["level"], i["text"]) for i in got[0]["items"]] == [(0, "a"), (1, "b"), (0, "c")]
    assert (got[0].list_type, got[2].list_type) == ("bullet", "numbered")


def test_odd_pages(spark):
    got = parsed(spark, None, "", "</ul><li>loose</li>", "<table></table>", "<ul><li></li></ul>", "<table><tr><td>&lt;x&gt;</td></tr></table>x")
    shape = [(r.template_version_id, r.block_type) for r in got]
    assert shape == [(2, "list"), (3, "table"), (5, "table"), (5, "paragraph")]
    assert got[0]["items"][0]["level"] == 0
    cells = B.cells(spark.createDataFrame(got[2:3], B.blocks(markup.elements(spark.createDataFrame([(1, "x")], "template_version_id bigint, html string"))).schema))
    assert cells.select("text").first().text == "<x>"


def test_tables_do_not_travel_with_the_text(spark):
    """Windows run over marks and texts of one page only; a page is one group at most."""
    df = spark.createDataFrame([(1, "<p>" + "x" * 10_000 + "</p>" + "<ul><li>y</li></ul>" * 500)], "template_version_id bigint, html string")
    got = markup.elements(df).groupBy("style_name").agg(F.count("*").alias("n")).collect()
    assert {r.style_name: r.n for r in got} == {"Normal": 1, "List Bullet": 500}
