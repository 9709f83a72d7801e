"""Small literal cases, among them the results that the operators are known by."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from leafmill.functions import scalars as S
from leafmill.operators import layout as L
from leafmill.operators import navigation as N
from leafmill.operators import objects as O
from leafmill.operators import pages as P
from leafmill.operators import text as T
from leafmill.sources import exports as X
from leafmill.sources import scans as C
from leafmill.streaming import sessions as Z


def pages(spark, n=3, doc=1):
    return spark.createDataFrame([(doc, i, f"Page {i + 1}", 595.0, 842.0, 0) for i in range(n)], "doc_id long, page_no int, text string, width double, height double, rotation int")


def texts(df):
    return [r.text for r in df.orderBy("doc_id", "page_no").collect()]


def spans(spark):
    rows = [(1, 0, 0, 0, 0, "Title", "Helvetica-Bold", 24.0, 16, 50.0, 76.0, 110.0, 100.0), (1, 0, 1, 0, 0, "body text here", "Helvetica", 11.0, 0, 50.0, 103.0, 127.0, 114.0), (1, 1, 0, 0, 0, "code", "Courier", 9.0, 8, 50.0, 41.0, 68.0, 50.0)]
    return spark.createDataFrame(rows, "doc_id long, page_no int, block int, line int, span int, text string, font string, size double, flags int, x0 double, y0 double, x1 double, y1 double")


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_scalars(spark):
    lit = F.lit
    row = one(spark, S.to_roman(lit(1994)).alias("a"), S.to_roman(lit(0)).alias("b"), S.to_letter(lit(27)).alias("c"), S.to_letter(lit(26)).alias("d"), S.cell_text(lit("x" * 21)).alias("e"), S.safe_filename(lit("a/../b.pdf"), lit("s")).alias("f"), S.safe_filename(lit("d/e"), lit("s")).alias("g"), S.parse_rect(lit("1, 2,3,4")).alias("h"), S.parse_rect(lit("3,2,1,4")).alias("i"), S.parse_rect(lit("1,x,3,4")).alias("j"), S.hex_to_rgb(lit("#ff0000")).alias("k"), S.hex_to_rgb(lit("#f00")).alias("l"), S.hex_to_rgb(lit("#f00"), named=True).alias("m"), S.hex_to_rgb(lit("nonsense"), named=True).alias("n"))
    assert (row.a, row.b, row.c, row.d) == ("MCMXCIV", "", "A", "Z")
    assert row.e == "x" * 20 + "..." and row.f is None and row.g == "s_e.pdf"
    assert tuple(row.h) == (1, 2, 3, 4) and row.i is None and row.j is None
    assert tuple(row.k) == (1, 0, 0) and row.l is None and tuple(row.m) == (1, 0, 0) and tuple(row.n) == (0, 0, 0)
    with pytest.raises(ValueError):
        S.number_label(lit(1), "runes")


def test_wrap_and_paginate(spark):
    import textwrap

    text = "one two three " * 40 + "\n\n   \n" + "w" * 100 + " tail"
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.lines for r in L.wrapped(df).collect()}
    assert got[1] == [x for line in text.split("\n") for x in textwrap.wrap(line, 80)] and got[2] == got[3] == []
    sizes = {(r.doc_id, r.page_no): (r.n_lines, r.n_chars) for r in L.page_sizes(df).collect()}
    assert sizes[2, 0] == sizes[3, 0] == (0, 0)
    many = spark.createDataFrame([(1, "x\n" * 109)], "doc_id long, text string")
    assert sorted((r.page_no, r.n_lines) for r in L.page_sizes(many).collect()) == [(0, 54), (1, 54), (2, 1)]


def test_markdown_and_html(spark):
    md = spark.createDataFrame([(1, "# Head\n\ntext **bold**\n- item one\n2. item two\n```\ncode  x\n```\n### Small")], "doc_id long, text string")
    assert [(r.tag, r.text) for r in L.scan_markdown(md).orderBy("i").collect()] == [("h1", "Head"), ("p", "text **bold**"), ("li", "item one"), ("li", "item two"), ("code", "code  x"), ("h3", "Small")]
    html = spark.createDataFrame([(1, "<html><body><p>HTML &amp; more</p><h2 class='x'>H</h2></body></html>"), (2, None)], "page_id long, html string")
    assert [(r.font, r.size, r.text) for r in L.html_spans(html).orderBy("block").collect()] == [("Helvetica", 11.0, "HTML & more"), ("Helvetica-Bold", 14.0, "H")]


def test_split_and_organize(spark):
    df = pages(spark, 5)
    parts = P.split_ranges(df, "1-2,4,6-9")
    assert sorted((r.part, r.n) for r in parts.groupBy("part").agg(F.count("*").alias("n")).collect()) == [(0, 2), (1, 1)]
    assert texts(P.organize_pages(pages(spark), [2, 0])) == ["Page 3", "Page 1"]
    assert texts(P.organize_pages(pages(spark), [2, 7, 2])) == ["Page 3", "Page 3"]


def test_merge(spark):
    both = pages(spark, 3, 1).unionByName(pages(spark, 3, 2))
    order = spark.createDataFrame([(9, 2, 0), (9, 1, 1), (8, 1, 0), (8, 77, 1)], "out_id long, doc_id long, pos int")
    merged, bad = P.merge_documents(both, order)
    assert [(r.doc_id, r.page_no, r.source_doc) for r in merged.orderBy("page_no").collect()] == [(9, i, 2 if i < 3 else 1) for i in range(6)]
    assert [r.doc_id for r in bad.collect()] == [77]


def test_page_edits(spark):
    df = pages(spark, 3)
    kept, bad = P.delete_pages(df, [1])
    assert texts(kept) == ["Page 1", "Page 3"] and bad.count() == 0 and P.delete_pages(df, [8])[1].count() == 1
    assert texts(P.extract_pages(df, [2, 0, 2])[0]) == ["Page 1", "Page 3"] and P.extract_pages(df, [5])[0].count() == 0
    assert texts(P.insert_pages(df, P.blank_pages(df), 1)) == ["Page 1", "", "Page 2", "Page 3"]
    assert texts(P.insert_pages(df, P.blank_pages(df), 99))[-1] == ""
    assert texts(P.duplicate_page(df, 0)[0]) == ["Page 1", "Page 1", "Page 2", "Page 3"]
    assert texts(P.duplicate_page(df, 0, 50)[0])[-1] == "Page 1"
    assert texts(P.move_page(df, 0, 2)) == ["Page 2", "Page 3", "Page 1"] and texts(P.move_page(df, 2, 0)) == ["Page 3", "Page 1", "Page 2"]
    assert [r.rotation for r in P.rotate_pages(df, -90, [0]).orderBy("page_no").collect()] == [270, 0, 0]
    with pytest.raises(ValueError):
        P.rotate_pages(df, 45, absolute=True)
    good, bad = P.crop_pages(df, F.lit(300.0), F.lit(0.0), F.lit(300.0), F.lit(0.0))
    assert good.count() == 0 and bad.count() == 3
    with pytest.raises(ValueError):
        P.page_templates(df)
    assert [r.label for r in P.page_labels(df, "letter", start=26).orderBy("page_no").collect()] == ["Z", "A", "B"]


def test_blank_pages(spark):
    df = spark.createDataFrame([(1, 0, "a"), (1, 1, " \n"), (1, 2, None), (2, 0, "")], "doc_id long, page_no int, text string")
    kept, report = P.remove_blank_pages(df, spark.createDataFrame([(1, 2)], "doc_id long, page_no int"))
    assert [(r.doc_id, r.page_no, r.text) for r in kept.orderBy("page_no").collect()] == [(1, 0, "a"), (1, 1, None)]
    assert {r.doc_id: (list(r.removed), r.n_left) for r in report.collect()} == {1: ([1], 2), 2: ([0], 0)}


def test_history(spark):
    log = [("edit", 1), ("edit", 2), ("undo", 0), ("edit", 3), ("redo", 0), ("undo", 0), ("undo", 0), ("undo", 0)]
    df = spark.createDataFrame([("s", i, k, v) for i, (k, v) in enumerate(log)] + [("t", 0, "undo", 0)], "session string, seq long, kind string, state long")
    rows = {r.session: r for r in P.replay_history(df).collect()}
    assert (rows["s"].n_states, rows["s"].cursor, rows["s"].current) == (2, 0, 1)
    assert (rows["t"].n_states, rows["t"].cursor, rows["t"].current) == (0, -1, None)


def test_text_search(spark):
    df = spark.createDataFrame([(1, 0, "aaaa b.b"), (1, 1, None)], "doc_id long, page_no int, text string")
    q = spark.createDataFrame([(1, "aa"), (2, "b.b"), (3, "zz"), (4, "")], "query_id long, query string")
    hits = sorted((r.query_id, r["at"], r.before, r.match, r.after) for r in T.search_context(df, q, 2).collect())
    assert hits == [(1, 0, "", "aa", "aa"), (1, 1, "a", "aa", "a "), (1, 2, "aa", "aa", " b"), (2, 5, "a ", "b.b", "")]
    with pytest.raises(ValueError):
        T.search_text(spans(spark), "  ")
    hit = T.search_text(spans(spark), "TEXT", ignore_case=True).first()
    assert (hit.idx, hit.hx0, hit.hx1) == (0, 50 + 5 * 5.5, 50 + 9 * 5.5) and len(hit.corners) == 4
    out, count = T.replace_text(spans(spark), "e", "EE")
    assert sorted(r.text for r in out.collect()) == ["TitlEE", "bodyEE".replace("EE", "") + " tEExt hEErEE", "codEE"]
    assert sorted((r.page_no, r.n_hits) for r in count.collect()) == [(0, 4), (1, 1)]


def test_search_context_of_many_queries(spark):
    """More queries than fit one literal, of all lengths, against a plain search; rows that repeat count each time."""
    texts = ["ab😀cd abcdefghij x", "the the theory of 123", "n7 n8 n10400", None, ""]
    rows = [(i, 0, t) for i, t in enumerate(texts)] + [(1, 0, texts[1]), (None, 3, "no id: abcdefghij")]
    asked = [(i, f"n{i}") for i in range(10_500)] + list(enumerate(["😀", "😀c", "the", "the", "abcdefghi", "abcdefghij x", "e t", "b", "12", None, ""], 20_000))
    df, q = spark.createDataFrame(rows, "doc_id long, page_no int, text string"), spark.createDataFrame(asked, "query_id long, query string")
    want = [(d, k, i, at, t[max(at - 4, 0) : at], w, t[at + len(w) : at + len(w) + 4]) for d, k, t in rows if t for i, w in asked if w for at in range(len(t)) if t.startswith(w, at)]
    got = [tuple(r) for r in T.search_context(df, q, 4).collect()]
    assert len(want) > 20 and sorted(got, key=str) == sorted(want, key=str)
    blocks = [tuple(r) for r in T.search_context(df, q, 4, term_chars=20_000).collect()]  # three automata
    assert sorted(blocks, key=str) == sorted(want, key=str)
    assert T.search_context(df, q.limit(0)).count() == 0


def test_a_hundred_thousand_terms(spark):
    """Rows that leave the scan are the hits, however many terms there are."""
    q = spark.range(100_000).select(F.col("id").alias("query_id"), F.concat(F.lit("term"), F.col("id"), F.lit(";")).alias("query"))
    df = spark.range(2_000).select(F.col("id").alias("doc_id"), F.lit(0).alias("page_no"), F.concat(F.repeat(F.lit("term"), 50), F.lit("term"), F.col("id") * 100, F.lit("; and so on")).alias("text"))
    got = T.search_context(df, q, 3)
    assert {(r.doc_id, r.query_id, r["at"], r.after) for r in got.collect()} == {(i, i * 100, 200, " an") for i in range(1000)}
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_fonts(spark):
    points = spark.createDataFrame([(1, 1, 0, 55.0, 100.0), (2, 1, 0, 5.0, 5.0)], "point_id long, doc_id long, page_no int, x double, y double")
    assert {r.point_id: r["size"] for r in T.font_at_points(spans(spark), points).collect()} == {1: 24.0, 2: None}
    names = spark.createDataFrame([(x,) for x in ("Helvetica-Bold", "Arial", "Times New Roman", "Unknown Bold Italic", "weird mono", None)], "font string")
    assert [r.match for r in T.match_font(names).collect()] == ["Helvetica", "Helvetica", "Times-Roman", "Helvetica-BoldOblique", "Courier", "Helvetica"]
    use = {r.font: (r.char_count, r.percentage, r.is_bold) for r in T.font_usage(spans(spark)).where("page_no = 0").collect()}
    assert use == {"Helvetica-Bold": (5, 26.32, True), "Helvetica": (14, 73.68, False)}


def test_toc_and_redaction(spark):
    old = spark.createDataFrame([(1, 0, 1, "Old", 1)], "doc_id long, idx int, level int, title string, page int")
    assert [(r.idx, r.level, r.title, r.page) for r in T.auto_toc(spans(spark), existing=old).orderBy("idx").collect()] == [(0, 1, "Old", 1), (1, 1, "Title", 1)]
    regions = spark.createDataFrame([(1, 0, 0.0, 0.0, 500.0, 101.0)], "doc_id long, page_no int, rx0 double, ry0 double, rx1 double, ry1 double")
    left, gone = T.redact_regions(spans(spark), regions)
    assert [r.text for r in gone.collect()] == ["Title"] and left.count() == 2
    assert one(spark, T.strip_html(F.lit("<b>x</b> < y")).alias("t")).t == "x < y" and one(spark, T.sanitize_text(F.lit("a\x00b\tc\n")).alias("t")).t == "ab\tc\n"
    assert X.export_markdown(spans(spark)).first().markdown == "# Title\nbody text here\n\n---\n\ncode\n\n---\n\n"
    nested = T.nested_layout(spans(spark)).where("page_no = 0").first()
    assert [b.lines[0].spans[0].text for b in nested.blocks] == ["Title", "body text here"]


def test_bookmarks_and_links(spark):
    entries = spark.createDataFrame([(1, 0, None, "A", 1), (1, 1, 2, None, 9)], "doc_id long, idx int, level int, title string, page int")
    kept, bad = N.set_toc(entries, pages(spark))
    assert [(r.level, r.title, r.page) for r in kept.collect()] == [(1, "A", 1)] and bad.first().message == "Item 1: Invalid page number 9"
    links = spark.createDataFrame([(1, 0, 0, "internal", 2), (1, 0, 1, "internal", 7), (1, 0, 2, "uri", None)], "doc_id long, page_no int, idx int, type string, dest_page int")
    assert [r.idx for r in N.broken_links(links, pages(spark)).collect()] == [1]
    edits = [(1, 0, "add", None, 1, "B", 2), (1, 1, "add", None, 1, " ", 2), (1, 2, "update", 0, None, "C", None), (1, 3, "delete", 5, None, None, None), (1, 4, "add", None, 1, "D", 9)]
    out, bad = N.edit_bookmarks(kept, spark.createDataFrame(edits, "doc_id long, seq int, kind string, idx int, level int, title string, page int"), pages(spark))
    assert [(r.idx, r.title, r.page) for r in out.orderBy("idx").collect()] == [(0, "C", 1), (1, "B", 2)] and sorted(r.item for r in bad.collect()) == ["1", "3", "4"]


def test_shapes_forms_metadata(spark):
    pt = "array<struct<x:double,y:double>>"
    shapes = spark.createDataFrame([(1, 0, 0, "polygon", [(0.0, 0.0), (1.0, 2.0)]), (1, 0, 1, "polyline", [(0.0, 5.0), (4.0, 2.0)]), (1, 0, 2, "freehand", None)], f"doc_id long, page_no int, idx int, type string, points {pt}")
    good, bad = O.shape_annotations(shapes)
    assert [(r.idx, r.x0, r.y0, r.x1, r.y1, r.n_points) for r in good.collect()] == [(1, 0.0, 2.0, 4.0, 5.0, 2)] and bad.count() == 2
    m = spark.createDataFrame([({"title": "a", "author": "b"},)], "m map<string,string>")
    assert m.select(O.edit_metadata(F.col("m"), {"title": "c", "subject": None}, clear_key="author").alias("m")).first().m == {"title": "c", "author": None}
    assert m.select(O.edit_metadata(F.col("m"), clear=True).alias("m")).first().m == {}
    path = '[{"type":"path","path":[["M",2,4],["L",6,8]]},{"type":"line","left":0,"top":0,"width":4,"height":2},{"type":"image","left":1}]'
    rows = O.canvas_annotations(spark.createDataFrame([(1, 0, path), (1, 1, "oops"), (1, 2, None)], "doc_id long, page_no int, payload string"), 2.0).collect()
    assert [(r.type, r.points) for r in rows] == [("ink", [1.0, 2.0, 3.0, 4.0]), ("line", None)]


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Name,Age,Country\nAnn,30,DE\nBob,41,FR\nEve,22,ES\n")
    assert C.scan_csv(spark, str(tmp_path / "a.csv")).dtypes[1] == ("Age", "int")
    (tmp_path / "t.txt").write_text("one\ntwo\n")
    assert [r.line for r in C.scan_text(spark, str(tmp_path / "t.txt")).orderBy("line_no").collect()] == ["one", "two", ""]
    (tmp_path / "x.pdf").write_bytes(b"%PDF-1.4")
    assert C.scan_files(spark, str(tmp_path)).first().length == 8
    with pytest.raises(FileNotFoundError):
        C.scan_files(spark, str(tmp_path), at_least=2)
    js = spark.createDataFrame([(1, '[{"name":"A","age":1},{"name":"B"},7]'), (2, '{"k":true}'), (3, "12"), (4, "[bad")], "doc_id long, payload string")
    got = sorted((r.doc_id, r.row_no, r.key, r.value) for r in C.scan_json(js).collect())
    assert got == [(1, 0, "age", "1"), (1, 0, "name", "A"), (1, 1, "age", ""), (1, 1, "name", "B"), (1, 2, "age", ""), (1, 2, "name", ""), (2, 0, "k", "true"), (3, 0, "", "12")]
    files = spark.createDataFrame([("a.pdf", b"%PDF-x", 6, "application/pdf"), ("a.doc", b"%PDF-x", 6, None), ("b.pdf", b"", 0, None), ("c.pdf", b"%PDF-x", 99, None), ("d.pdf", b"hello!", 6, None), ("e.pdf", b"%PDF-x", 6, "image/png")], "path string, content binary, length long, content_type string")
    assert [r.reject_reason for r in C.ingest_gate(files, 50).orderBy(F.col("path") != "a.pdf", "path").collect()] == [None, "wrong extension", "empty file", "too large", "bad signature", "content type not allowed"]


def test_run_batch(spark, tmp_path):
    """An input whose plan fails, one that fails at a row (an ANSI cast), two with one output's name: the others are there."""
    reg = {"up": lambda df: df.withColumn("text", F.upper("text")), "only": lambda df, n: df.where(F.col("missing") > n)}
    more = pages(spark).withColumn("missing", F.lit(1))
    bad = more.withColumn("missing", F.when(F.col("page_no") >= 0, F.lit("x")).cast("int"))
    out, report = C.run_batch({"a.txt": pages(spark), "b.txt": more, "c.txt": bad, "b.csv": more, "d": more}, [("up", {}), ("only", {"n": 0})], reg, str(tmp_path / "out"), at_once=1)
    rows = {r.input: r for r in report.collect()}
    assert sorted(out) == ["b_processed", "d_processed"] and {i for i, r in rows.items() if r.ok} == {"b.txt", "d"}
    assert (rows["a.txt"].step, rows["c.txt"].step, rows["b.csv"].step) == ("only", "run", "run") and "CAST" in rows["c.txt"].error and rows["d"].n_rows == pages(spark).count()
    assert sorted(map(str, out["d_processed"].collect())) == sorted(map(str, reg["up"](more).collect()))
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")) == ["b_processed", "d_processed"]
    again, report = C.run_batch({"d": more}, [("up", {}), ("only", {"n": 0})], reg, str(tmp_path / "out"))
    assert not again and "is there already" in report.first().error
    out, report = C.run_batch({f"i{k}": more for k in range(6)}, [("up", {})], reg)
    assert sorted(out) == [f"i{k}_converted" for k in range(6)] and report.where("ok").count() == 6
    for steps in ([], [("nope", {})]):
        with pytest.raises(ValueError):
            C.run_batch({}, steps, reg)


def test_scalars_of_json_and_types_of_csv(spark, tmp_path):
    js = spark.createDataFrame([(1, r'"a\nb \u00e9"'), (2, "null"), (3, "-1.50"), (4, "true"), (5, '""')], "doc_id long, payload string")
    assert {r.doc_id: r.value for r in C.scan_json(js).collect()} == {1: "a\nb é", 2: "null", 3: "-1.50", 4: "true", 5: ""}
    (tmp_path / "t.csv").write_text('"a,b",c,d\n1,"x ""y""",2.5\n2,,3\n')
    back = C.scan_csv(spark, str(tmp_path / "t.csv"))
    assert back.dtypes == [("a,b", "int"), ("c", "string"), ("d", "double")] and [tuple(r) for r in back.collect()] == [(1, 'x "y"', 2.5), (2, None, 3.0)]


def test_edits_of_one_key(spark):
    fields = spark.createDataFrame([(1, 0, "f", "old", 0), (1, 1, "f", "old", 0), (1, 0, "g", "old", 0)], "doc_id long, page_no int, name string, value string, flags int")
    values = spark.createDataFrame([(1, "f", "b", 1), (1, "f", "a", 2), (1, "f", None, 3), (1, "nope", "x", 1), (1, "nope", "y", 2)], "doc_id long, name string, value string, seq int")
    out, bad = O.fill_forms(fields, values)
    assert sorted((r.page_no, r.name, r.value) for r in out.collect()) == [(0, "f", "a"), (0, "g", "old"), (1, "f", "a")] and bad.count() == 1
    assert {r.value for r in O.fill_forms(fields, values.drop("seq"))[0].where("name = 'f'").collect()} == {"b"}
    notes = spark.createDataFrame([(1, 0, 0, "black", "white", 1.0, "S", 1.0)], "doc_id long, page_no int, idx int, stroke string, fill string, border_width double, border_style string, opacity double")
    edits = spark.createDataFrame([(1, 0, 0, "red", None, 2.0, None, None, 1), (1, 0, 0, "blue", "green", None, 1, None, 2), (1, 0, 0, "no", None, None, 9, None, 3)], "doc_id long, page_no int, idx int, stroke string, fill string, border_width double, style int, opacity double, seq int")
    out, bad = O.restyle_annotations(notes, edits)
    assert [tuple(r)[3:] for r in out.collect()] == [("blue", "green", 2.0, "D", 1.0)] and bad.count() == 1


def test_grids_equal_all_pairs(spark):
    """Boxes of all sizes, on edges, below zero, without sides or turned around, against every point and region."""
    import random

    rng = random.Random(3)
    side = lambda: rng.choice([0.0, 0.001, 1.0, 2.0, 3.5, 11.0, 64.0, 500.0, 4096.0])
    at = lambda: rng.choice([-5.0, 0.0, 1.0, 2.0, 64.0, 128.0, rng.uniform(-300, 300)])
    boxes = []
    for i in range(150):
        x, y = at(), at()
        boxes.append((1, rng.choice([0, 1]), i // 10, i % 10, 0, f"f{i}", 10.0, x, y, x + side(), y + side()))
    boxes += [(1, 0, 90, 0, 0, "null", 1.0, None, 0.0, 9.0, 9.0), (1, 0, 91, 0, 0, "turned", 1.0, 9.0, 0.0, 1.0, 9.0)]
    spans_ = spark.createDataFrame(boxes, "doc_id long, page_no int, block int, line int, span int, font string, size double, x0 double, y0 double, x1 double, y1 double")
    points_ = [(i, 1, rng.choice([0, 1, 2]), at(), at()) for i in range(120)]
    got = {r.point_id: r.font for r in T.font_at_points(spans_, spark.createDataFrame(points_, "point_id long, doc_id long, page_no int, x double, y double")).collect()}
    full = [b for b in boxes if b[7] is not None and b[7] <= b[9]]
    want = {p[0]: min(((b[2:5], b[5]) for b in full if b[1] == p[2] and b[7] <= p[3] <= b[9] and b[8] <= p[4] <= b[10]), default=(None, None))[1] for p in points_}
    assert got == want and len(set(want.values())) > 5
    regions_ = [(1, rng.choice([0, 1]), x, y, x + side(), y + side()) for x, y in ((at(), at()) for _ in range(12))]
    kept, gone = T.redact_regions(spans_, spark.createDataFrame(regions_, "doc_id long, page_no int, rx0 double, ry0 double, rx1 double, ry1 double"))
    hit = {b[5] for b in full for r in regions_ if b[1] == r[1] and b[7] < r[4] and b[9] > r[2] and b[8] < r[5] and b[10] > r[3]}
    assert {r.font for r in gone.collect()} == hit and {r.font for r in kept.collect()} == {b[5] for b in boxes} - hit and 5 < len(hit) < 140


def test_a_crowded_page(spark):
    """100,000 spans and 100,000 points on one page: pairs that are looked at stay near the number of points."""
    n = 100_000
    spans_ = spark.range(n).select(F.lit(1).alias("doc_id"), F.lit(0).alias("page_no"), F.col("id").alias("block"), F.lit(0).alias("line"), F.lit(0).alias("span"), F.lit("F").alias("font"), (F.col("id") % 7).cast("double").alias("size"), F.lit(50.0).alias("x0"), (F.col("id") * 14.0).alias("y0"), F.lit(500.0).alias("x1"), (F.col("id") * 14.0 + 11).alias("y1"))
    points_ = spark.range(n).select(F.col("id").alias("point_id"), F.lit(1).alias("doc_id"), F.lit(0).alias("page_no"), (F.col("id") % 600).cast("double").alias("x"), (F.col("id") * 14.0 + 5).alias("y"))
    found = T.font_at_points(spans_, points_)
    assert found.where("font is not null").count() == sum(50 <= i % 600 <= 500 for i in range(n))
    regions_ = spark.range(0, n, 10).select(F.lit(1).alias("doc_id"), F.lit(0).alias("page_no"), F.lit(0.0).alias("rx0"), (F.col("id") * 14.0).alias("ry0"), F.lit(60.0).alias("rx1"), (F.col("id") * 14.0 + 11).alias("ry1"))
    assert T.redact_regions(spans_, regions_)[1].count() == n // 10


def test_pages_of_a_table_of_any_size(spark):
    rows = spark.range(5_000).select(F.when(F.col("id") % 10 > 0, F.lit("big")).when(F.col("id") % 20 > 0, F.lit("small")).alias("t"), F.col("id"), F.lit("a cell text of more than twenty").alias("c")).repartition(7)
    got = L.paginate_table(rows, ["t"], ["id"], ["id", "c"], 3, 10).collect()
    want = {}
    for t, ids in (("big", [i for i in range(5_000) if i % 10]), ("small", [i for i in range(5_000) if i % 20 == 10]), (None, list(range(0, 5_000, 20)))):
        for n, i in enumerate(ids):
            want[i] = (t, 0, n) if n < 3 else (t, 1 + (n - 3) // 10, (n - 3) % 10)
    assert {int(r.id): (r.t, r.page_no, r.row_no) for r in got} == want


def test_tables(spark):
    df = spark.createDataFrame([(1, 0, "Col1 Col2\n\nVal1   Val2 x"), (1, 1, None)], "doc_id long, page_no int, text string")
    assert [(r.row, r.col, r.cell) for r in L.text_table(df).orderBy("row", "col").collect()] == [(0, 0, "Col1"), (0, 1, "Col2"), (1, 0, "Val1"), (1, 1, "Val2"), (1, 2, "x")]
    rows = spark.range(60).select(F.lit(1).alias("t"), "id")
    assert sorted((r.page_no, r["count"]) for r in L.paginate_table(rows, ["t"], ["id"], ["id"]).groupBy("page_no").count().collect()) == [(0, 28), (1, 28), (2, 4)]


def stamps(spark, seconds, client="c"):
    return spark.createDataFrame([(client, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s), i) for i, s in enumerate(seconds)], "client string, ts timestamp_ntz, id long")


def test_rate_admission_does_not_count_rejected(spark):
    rows = Z.rate_admission(stamps(spark, [0, 1, 2, 3, 60, 61, 62]), 2, 60).orderBy("id").collect()
    assert [r.admitted for r in rows] == [True, True, False, False, True, True, False]
    key = Z.client_key(F.lit(" 1.2.3.4 , 5"), F.lit("9"), F.lit("p"))
    assert one(spark, key.alias("a"), Z.client_key(F.lit(""), F.lit(None).cast("string"), F.lit(None).cast("string")).alias("b")) == ("1.2.3.4", "unknown")


def _streamed(spark, df, name, tmp_path, build, mode="append", batches=3, order="ts"):
    """Runs build over df dealt to files, one micro-batch each."""
    src, rows = tmp_path / name, df.orderBy(order).collect()
    size = -(-len(rows) // batches)
    for k in range(batches):
        spark.createDataFrame(rows[k * size : (k + 1) * size], df.schema).coalesce(1).write.mode("append").parquet(str(src / f"b{k}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(src))
    q = build(stream).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}-c")).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_streamed_admission_equals_batch(spark, tmp_path):
    df = stamps(spark, [0, 1, 2, 3, 30, 60, 61, 62, 63, 100, 121, 122]).unionByName(stamps(spark, [5, 6, 7, 90], "d"))
    batch = sorted((r.client, r.id, r.admitted, r.remaining) for r in Z.rate_admission(df, 2, 60).collect())
    live = df.withColumn("ts", F.col("ts").cast("timestamp"))
    got = _streamed(spark, live, "admitted", tmp_path, lambda s: Z.rate_admission_stream(s, 2, 60))
    assert sorted((r.client, r.id, r.admitted, r.remaining) for r in got.collect()) == batch


def test_streamed_metrics_drop_late_rows(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(minutes=m), "/a", 200, float(m)) for i, m in enumerate([0, 5, 61, 62, 200, 201, 1, 400, 401])]
    df = spark.createDataFrame(rows, "n long, ts timestamp, path string, status int, duration double")
    got = _streamed(spark, df, "metrics", tmp_path, lambda s: Z.request_metrics(s, "1 hour"), batches=9, order="n")
    counts = {r.window_start.hour: r.n for r in got.collect()}
    assert counts[0] == 2 and counts[1] == 2 and counts[3] == 2  # the row of minute 1 came after its hour was closed


def test_streamed_upsert_and_recent_files(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [(f"s{i % 3}", base + dt.timedelta(minutes=i), i == 7, f"f{i}") for i in range(9)]
    df = spark.createDataFrame(rows, "session_id string, ts timestamp, deleted boolean, filename string")
    want = {r.session_id: r.filename for r in Z.session_upsert(df).collect()}
    src = tmp_path / "up"
    for k in range(3):
        spark.createDataFrame(rows[3 * k : 3 * k + 3], df.schema).coalesce(1).write.parquet(str(src / f"b{k}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(src))
    q = Z.upsert_stream(stream, str(tmp_path / "state"), str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert {r.session_id: r.filename for r in Z.stored_sessions(spark, str(tmp_path / "state"), df.schema).collect()} == want
    q = Z.upsert_stream(stream, str(tmp_path / "merged"), str(tmp_path / "ck2"), merge_every=2).start()
    q.processAllAvailable()
    q.stop()
    assert {r.session_id: r.filename for r in Z.stored_sessions(spark, str(tmp_path / "merged"), df.schema).collect()} == want
    assert len(list((tmp_path / "merged" / "data").iterdir())) == 3  # the merged table, and the two of the version before
    opened = df.select(F.lit(1).alias("user_id"), F.col("filename").alias("name"), "ts")
    got = _streamed(spark, opened, "recent", tmp_path, lambda s: Z.recent_files_stream(s, 4), mode="update")
    assert ["f8", "f7", "f6", "f5"] in [r.names for r in got.collect()]
    assert [r.name for r in Z.recent_files(opened, 4).orderBy("rank").collect()] == ["f8", "f7", "f6", "f5"]


def test_expiry(spark):
    s = spark.createDataFrame([("a", dt.datetime(2024, 1, 1)), ("b", dt.datetime(2024, 1, 2, 12)), ("c", dt.datetime(2024, 1, 1))], "session_id string, last_modified timestamp_ntz")
    out = Z.expire_sessions(s, F.expr("timestamp_ntz'2024-01-03 00:00:00'"), s.where("session_id = 'c'"))
    assert [r.session_id for r in out.collect()] == ["a"]


def test_streamed_expiry(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [("a", base), ("b", base + dt.timedelta(hours=1)), ("a", base + dt.timedelta(hours=2)), ("b", base + dt.timedelta(hours=90)), ("c", base + dt.timedelta(hours=91)), ("c", base + dt.timedelta(hours=200))]
    df = spark.createDataFrame(rows, "session_id string, ts timestamp")
    got = _streamed(spark, df, "expired", tmp_path, lambda s: Z.expire_stream(s, 24), batches=6)
    assert sorted((r.session_id, r.started, r.ended, r.n) for r in got.collect()) == [("a", base, base + dt.timedelta(hours=26), 2), ("b", base + dt.timedelta(hours=1), base + dt.timedelta(hours=25), 1), ("b", base + dt.timedelta(hours=90), base + dt.timedelta(hours=114), 1), ("c", base + dt.timedelta(hours=91), base + dt.timedelta(hours=115), 1)]


def test_late_rows_are_counted(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    for k, m in enumerate([0, 5, 300, 301, 1, 2, 400]):
        spark.createDataFrame([(base + dt.timedelta(minutes=m), "/a", 200, 1.0)], "ts timestamp, path string, status int, duration double").coalesce(1).write.parquet(str(tmp_path / "late" / f"b{k}"))
    stream = spark.readStream.schema("ts timestamp, path string, status int, duration double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("latestFirst", False).parquet(str(tmp_path / "late"))
    seen = Z.LateRows.watch(spark)
    q = Z.request_metrics(stream, "1 hour").writeStream.outputMode("append").format("noop").option("checkpointLocation", str(tmp_path / "late-c")).start()
    q.processAllAvailable()
    q.stop()
    for _ in range(600):  # the listener hears of the last batches a little later
        if seen.of(q) == 2:
            break
        time.sleep(0.1)
    assert seen.of(q) == 2


def test_recent_files_state_goes(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [(1, "x", base), (2, "y", base + dt.timedelta(days=10)), (2, "z", base + dt.timedelta(days=11)), (1, "w", base + dt.timedelta(days=12))]
    df = spark.createDataFrame(rows, "user_id long, name string, ts timestamp")
    got = _streamed(spark, df, "going", tmp_path, lambda s: Z.recent_files_stream(s, 4, ttl_days=2), mode="update", batches=4)
    assert [r.names for r in got.where("user_id = 1").collect()] == [["x"], ["w"]] and ["z", "y"] in [r.names for r in got.collect()]


def test_admission_of_one_busy_client(spark):
    """Pauses, days and a client with most of the requests: the same as going through all of them in order."""
    import random

    rng = random.Random(2)
    base = dt.datetime(2024, 1, 1)
    rows = [(c, base + dt.timedelta(microseconds=rng.randrange(4 * 86_400) * 1_000_000), i) for i, c in enumerate(["busy"] * 3000 + [None] * 200 + ["x", "y"] * 50)]
    held, want = {}, {}
    for c, ts, i in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        live = [h for h in held.get(c, []) if h > ts - dt.timedelta(seconds=300)]
        ok = len(live) < 2
        held[c] = live + [ts] * ok
        want[i] = (c, ts, ok, 2 - len(held[c]))
    df = spark.createDataFrame(rows, "client string, ts timestamp_ntz, id long").repartition(5)
    got = {r.id: (r.client, r.ts, r.admitted, r.remaining) for r in Z.rate_admission(df, 2, 300).collect()}
    assert got == want and Z.rate_admission(df.limit(0), 2, 300).count() == 0


def test_replays_of_long_logs(spark):
    log = spark.range(30_000).select(F.lit("s").alias("session"), F.col("id").alias("seq"), F.when(F.col("id") % 7 == 3, "undo").when(F.col("id") % 11 == 5, "redo").otherwise("edit").alias("kind"), F.col("id").alias("state"))
    states, at = [], -1
    for r in log.orderBy("seq").collect():
        if r.kind == "edit":
            states = (states[: at + 1] + [r.state])[-50:]
            at = len(states) - 1
        else:
            at = max(at - 1, min(0, len(states) - 1)) if r.kind == "undo" else min(at + 1, len(states) - 1)
    assert tuple(P.replay_history(log.repartition(3)).first()) == ("s", len(states), at, states[at])
    assert P.replay_history(log.limit(0)).count() == 0
    ops = spark.createDataFrame([(1, 0, "delete", 5), (1, 1, "duplicate", 1), (1, 2, "to_front", 3), (2, 0, "delete", 0), (2, 1, "other", 0)], "doc_id long, seq long, kind string, arg long")
    counts = spark.createDataFrame([(1, 4), (2, 1), (3, 9)], "doc_id long, n_pages long")
    assert {r.doc_id: r.pages for r in P.replay_page_ops(counts, ops)[0].collect()} == {1: [3, 0, 2, 2], 2: [0]}


def test_corpus_numbers_of_sparse_ids(spark):
    ids = sorted({-(3**30), *(7**k for k in range(22)), *range(40)})
    df = spark.createDataFrame([(i, p) for i in ids for p in range(1 + abs(i) % 3)], "doc_id long, page_no int").repartition(4)
    got = [r.corpus_no for r in P.corpus_numbers(df, 8).orderBy("doc_id", "page_no").collect()]
    assert got == list(range(1, len(got) + 1)) and P.corpus_numbers(df.limit(0)).count() == 0


def test_wrapping_equals_textwrap(spark):
    import textwrap

    lines = ["tail " + "w" * 100, "  lead  and   runs " * 9, "a\tb\tc " * 12, "well-known half-open semi-automatic " * 6, "word--dash " * 15, "x" * 79 + " y", "x" * 81, "-" * 100, "a" * 70 + " " + "b-c-d-efgh-ijkl" * 10, "", " \t ", "日本語-漢字 " * 20, "end" + " " * 100 + "x"]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    assert {r.doc_id: r.lines for r in L.wrapped(df).collect()} == {i: textwrap.wrap(x, 80) for i, x in enumerate(lines)}


def test_inline_markup_keeps_its_text(spark):
    html = "<style>p{}</style><p>one <b>two</b> three</p><H1 class='x'>Head<br/>line &amp; &lt;b></H1><ul><li>a<li><a href=u>link</a> rest</ul>tail<!-- no --><script>x<p>y</script><pre>code</pre>"
    got = [(r.i, r.tag, r.text) for r in L.scan_html(spark.createDataFrame([(1, html), (2, None), (3, "bare")], "page_id long, html string")).orderBy("doc_id", "i").collect()]
    assert got == [(0, "p", "one two"), (1, "p", "three"), (2, "h1", "Head line & <b>"), (3, "li", "a"), (4, "li", "link"), (5, "p", "rest"), (6, "p", "tail"), (7, "pre", "code"), (0, "p", "bare")]
    links = spark.createDataFrame([(1, "<a href=\"x\">1</a><A class=b HREF='https://y'>2</A><a href=#z>3</a><abbr href=no>")], "page_id long, html string")
    assert [(r.idx, r.target, r.type) for r in N.page_links(links).orderBy("idx").collect()] == [(0, "x", "internal"), (1, "https://y", "uri"), (2, "#z", "named")]


def test_fixed_tables(spark):
    """Fonts, colour spaces, colours, file names and canvas objects as they are prescribed."""
    fonts = {"Palatino": "Times-Roman", "Bookman Old Style": "Times-Roman", "Times New Roman": "Times-Roman", "Courier New Bold": "Courier", "Calibri": "Helvetica", "Times-BoldItalic": "Times-Bold", "Mono Bold": "Helvetica-Bold", "Serif Oblique": "Helvetica-Oblique", "My Serif": "Times-Roman", "ABC+Courier-Bold": "Courier"}
    names = spark.createDataFrame([(x,) for x in fonts], "font string")
    assert {r.font: r.match for r in T.match_font(names).collect()} == fonts
    images = spark.createDataFrame([(1, 0, k, 10, 5, 8, k, None, 0, 1) for k in range(5)], "doc_id long, page_no int, idx int, width int, height int, bits_per_component int, color_space int, compression string, mask int, size_bytes long")
    assert [r.color_space_name for r in O.image_inventory(images).orderBy("idx").collect()] == ["DeviceGray", "DeviceRGB", "DeviceCMYK", "Indexed", "Unknown(4)"]
    colours = spark.createDataFrame([(x,) for x in ("green", "Dark", "orange", "GRAY", "#0f0", "00ff00", "p urple")], "c string")
    assert [tuple(r.v) for r in colours.select(S.hex_to_rgb(F.col("c"), named=True).alias("v")).collect()] == [(0, 0.5, 0), (0, 0, 0), (1, 0.5, 0), (0.5, 0.5, 0.5), (0, 1, 0), (0, 0, 0), (0.5, 0, 0.5)]
    files = {"a.txt": "s_a.pdf", "b": "s_b.pdf", "d/e.x.PDF": "s_e.x.pdf", "/abs/f.pdf": "s_f.pdf", "g/../h": None, "./i": None, "~j": None, "": None, "k//l": None, "x" * 300: None}
    df = spark.createDataFrame([(x,) for x in files], "n string")
    assert {r.n: r.f for r in df.select("n", S.safe_filename(F.col("n"), F.lit("s")).alias("f")).collect()} == files
    body = '[{"type":"circle","left":1,"top":2,"width":3,"height":4,"stroke":"#111"},{"type":"circle","left":1,"top":2,"radius":5},{"type":"image","src":"a","left":1,"top":2},{"type":"image","left":1,"top":2,"width":9,"height":9},{"type":"text","text":"t","left":0,"top":0,"fill":"#222"}]'
    rows = O.canvas_annotations(spark.createDataFrame([(1, 0, body)], "doc_id long, page_no int, payload string")).orderBy("idx").collect()
    assert [(r.idx, r.type, r.x1, r.y1, r.stroke) for r in rows] == [(0, "circle", 4.0, 6.0, "#111"), (2, "stamp", 101.0, 102.0, "#000000"), (4, "freetext", 100.0, 50.0, "#222")]


def test_exports_of_documents_without_tables(spark, tmp_path):
    cells = spark.createDataFrame([(1, 0, 0, 0, "a"), (1, 3, 0, 0, "b")], "doc_id long, page_no int, row int, col int, cell string")
    docs = spark.createDataFrame([(1,), (2,), (2,)], "doc_id long")
    got = sorted((r.doc_id, r.sheet, r.cell) for r in X.export_tables(cells, docs).collect())
    assert got == [(1, "Table_1", "a"), (1, "Table_2", "b"), (2, "Table_1", "No tables or text found in PDF")]
    X.write_texts(spark.createDataFrame([(1, "a\nb"), (2, None)], "doc_id long, text string"), str(tmp_path / "t"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "t")).collect()) == ['{"doc_id":1,"text":"a\\nb"}', '{"doc_id":2}']


def test_places_of_many_hits(spark):
    import time

    cases = [("aaaa", "aa", [0, 1, 2]), ("xaxa", "a", [1, 3]), ("", "a", []), ("a.b", ".", [1]), ("é日é日é", "é日é", [0, 2])]
    df = spark.createDataFrame(cases, "t string, q string, want array<int>")
    assert all(r.got == r.want for r in df.withColumn("got", T.places(F.col("t"), F.col("q"))).collect())
    began = time.perf_counter()
    many = spark.createDataFrame([("ab" * 100_000,)], "t string").select(T.places(F.col("t"), F.lit("ba")).alias("p")).first().p
    assert many == list(range(1, 199_999, 2)) and time.perf_counter() - began < 60
