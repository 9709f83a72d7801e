import os

import pytest

from leafmill.plans import catalog
from tests.oracle import spark_rows, sql_rows

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    assert spark_rows(df, columns) == sql_rows(catalog.oracle_sql()[name], SF, columns)


def test_every_query_has_sql():
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == {"scan_files"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_scan_files(spark):
    rows = {r.name: r.bytes for r in catalog.queries()["scan_files"](spark, SF).collect()}
    assert rows == {n: os.path.getsize(f"{SF}/{n}") for n in os.listdir(SF) if n.endswith(".parquet")}


def test_plans_stay_in_the_engine(spark):
    """No Python in the plans of batch operators, and no cross joins or unpartitioned sorts of whole tables."""
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    for name in ("paginate_text", "html_spans", "font_usage", "object_tree"):
        plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def test_search_shuffles_no_page(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    plan = catalog.queries()["search_context"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "MapInArrow" in plan


def test_whole_documents_and_their_limits(spark, tmp_path):
    """60 blocks are two pages, six turns are six: a query of whole documents has all of them, a limited one the first."""
    html = "".join(f"<p>block {i}</p>" for i in range(60))
    spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame([(1, i, "user", "t") for i in range(6)], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    for name in ("part", "events"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    run = lambda name: catalog.queries()[name](spark, str(tmp_path)).collect()
    assert [r.text for r in run("extract_text_whole")] == ["".join(f"block {i} \n" for i in range(60))]
    assert [r.text for r in run("extract_text")] == ["".join(f"block {i} \n" for i in range(54))]
    assert sorted((r.page_no, r.n_blocks) for r in run("object_tree_whole")) == [(0, 54), (1, 6), (2, 0), (3, 0), (4, 0), (5, 0)]
    assert sorted(r.page_no for r in run("object_tree")) == [0, 1, 2, 3]


#: Bold text beside plain text of its own block, and on a page without a heading.
BOLD = [(1, "<h1>Top</h1><p>one <b>two</b> three</p>"), (2, "<p><B class='x'>four<br>five</b></p><p>six</p>"), (3, None)]


def bold_pages(spark, tmp_path, name):
    """Rows of a query on BOLD, checked against its SQL."""
    spark.createDataFrame(BOLD, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    df = catalog.queries()[name](spark, str(tmp_path))
    assert spark_rows(df, sorted(df.columns)) == sql_rows(catalog.oracle_sql()[name], str(tmp_path), sorted(df.columns))
    return df.collect()


def test_scan_html_has_bold_pieces(spark, tmp_path):
    rows = bold_pages(spark, tmp_path, "scan_html")
    assert sorted((r.doc_id, r.i, r.tag, r.text) for r in rows) == [(1, 0, "h1", "Top"), (1, 1, "p", "one"), (1, 2, "b", "two"), (1, 3, "p", "three"), (2, 0, "b", "four five"), (2, 1, "p", "six")]


def test_html_spans_have_bold_fonts(spark, tmp_path):
    rows = bold_pages(spark, tmp_path, "html_spans")
    assert sorted((r.doc_id, r.block, r.font, r.size, r.flags) for r in rows if r.flags == 16) == [(1, 0, "Helvetica-Bold", 18.0, 16), (1, 2, "Helvetica-Bold", 11.0, 16), (2, 0, "Helvetica-Bold", 11.0, 16)]
    assert len(rows) == 6


def test_text_properties_of_bold_text(spark, tmp_path):
    rows = bold_pages(spark, tmp_path, "text_properties")
    assert sorted(r.text for r in rows if r.is_bold) == ["Top", "four five", "two"]


def test_replaced_text_keeps_bold_fonts(spark, tmp_path):
    rows = bold_pages(spark, tmp_path, "replace_text")
    assert sorted((r.text, r.font) for r in rows) == [("Top", "Helvetica-Bold"), ("four five", "Helvetica-Bold"), ("one", "Helvetica"), ("six", "Helvetica"), ("three", "Helvetica"), ("two", "Helvetica-Bold")]


def test_font_usage_of_bold_text(spark, tmp_path):
    rows = bold_pages(spark, tmp_path, "font_usage")
    assert sorted((r.doc_id, r.font, r.size, r.char_count, r.is_bold) for r in rows) == [(1, "Helvetica", 11.0, 8, False), (1, "Helvetica-Bold", 11.0, 3, True), (1, "Helvetica-Bold", 18.0, 3, True), (2, "Helvetica", 11.0, 3, False), (2, "Helvetica-Bold", 11.0, 9, True)]


def test_document_fonts_of_bold_text(spark, tmp_path):
    rows = bold_pages(spark, tmp_path, "document_fonts")
    assert sorted((r.doc_id, r.font, r.pages) for r in rows) == [(1, "Helvetica", "0"), (1, "Helvetica-Bold", "0"), (2, "Helvetica", "0"), (2, "Helvetica-Bold", "0")]


def test_font_at_points_of_bold_text(spark, tmp_path):
    points = [(1, 3.0, '{"k": 14}'), (2, 3.0, '{"k": 1}'), (251, 3.0, '{"k": 8}'), (252, 900.0, '{"k": 1}')]
    spark.createDataFrame(points, "event_id long, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    rows = bold_pages(spark, tmp_path, "font_at_points")
    assert {r.point_id: r.font for r in rows} == {1: "Helvetica-Bold", 2: "Helvetica-Bold", 251: "Helvetica", 252: None}
