"""Queries of annotations, images, forms, metadata and whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.operators import objects as O
from leafmill.operators import pages as P
from leafmill.operators.layout import html_spans
from leafmill.plans.base import AN, CNT, FF, IM, PG, SP, annotations, conversation_pages, form_fields, images, query, table


@query("""SELECT user_id AS doc_id, page_no, 0 AS idx, CASE t WHEN 'rect' THEN 'square' WHEN 'circle' THEN 'circle' WHEN 'image' THEN 'stamp' ELSE 'freetext' END AS type, k / 2.0::DOUBLE AS x0, value / 2 AS y0,
 CASE t WHEN 'circle' THEN (k + 14) / 2.0::DOUBLE WHEN 'rect' THEN (k + 10) / 2.0::DOUBLE ELSE (k + 100) / 2.0::DOUBLE END AS x1, CASE t WHEN 'circle' THEN (value + 12) / 2 WHEN 'rect' THEN (value + 30) / 2 WHEN 'image' THEN (value + 100) / 2 ELSE (value + 50) / 2 END AS y1, CASE WHEN t = 'text' THEN event_type END AS contents
FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k, CAST(event_id % 5 AS INTEGER) AS page_no, CASE event_id % 5 WHEN 0 THEN 'rect' WHEN 1 THEN 'circle' WHEN 2 THEN 'text' WHEN 3 THEN 'image' ELSE 'bad' END AS t FROM events) WHERE t <> 'bad'""")
def canvas_annotations(spark, d):
    i = F.col("event_id")
    place = F.concat(F.lit('"left":'), F.get_json_object("props", "$.k"), F.lit(',"top":'), F.col("value").cast("string"))
    body = F.when(i % 5 == 0, F.concat(F.lit('[{"type":"rect",'), place, F.lit(',"width":10,"height":30},{"type":"rect"}]'))).when(i % 5 == 1, F.concat(F.lit('{"objects":[{"type":"circle",'), place, F.lit(',"width":14,"height":12},{"type":"circle","left":1,"top":2,"radius":7}]}'))).when(i % 5 == 2, F.concat(F.lit('[{"type":"i-text",'), place, F.lit(',"text":"'), F.col("event_type"), F.lit('"},{"type":"text","left":1,"top":1,"text":" "}]'))).when(i % 5 == 3, F.concat(F.lit('[{"type":"image","src":"a.png",'), place, F.lit('},{"type":"image","left":1,"top":2,"width":3,"height":4}]'))).otherwise(F.lit("[{not json"))
    canvas = table(spark, d, "events").select(F.col("user_id").alias("doc_id"), (i % 5).cast("int").alias("page_no"), body.alias("payload"))
    return O.canvas_annotations(canvas, 2.0).select("doc_id", "page_no", "idx", "type", "x0", "y0", "x1", "y1", "contents")


@query(f"""WITH {AN}, s AS (SELECT doc_id, page_no, type, count(*) AS n_points, min(k) AS x0, min(value) AS y0, max(k) AS x1, max(value) AS y1 FROM an GROUP BY 1, 2, 3) SELECT doc_id, page_no, type, CAST(x0 AS DOUBLE) AS x0, y0, CAST(x1 AS DOUBLE) AS x1, y1, CAST(n_points AS BIGINT) AS n_points FROM s WHERE n_points >= CASE WHEN type = 'error' THEN 3 ELSE 2 END""")
def shape_annotations(spark, d):
    a = annotations(spark, d)
    shapes = a.groupBy("doc_id", "page_no", "type").agg(F.array_sort(F.collect_list(F.struct(F.col("k").cast("double").alias("x"), F.col("value").alias("y")))).alias("points"))
    good, _ = O.shape_annotations(shapes.select("doc_id", "page_no", F.lit(0).alias("idx"), F.when(F.col("type") == "error", "polygon").otherwise(F.col("type")).alias("type"), "points"))
    return good.select("doc_id", "page_no", F.when(F.col("type") == "polygon", "error").otherwise(F.col("type")).alias("type"), "x0", "y0", "x1", "y1", "n_points")


@query(f"WITH {AN} SELECT doc_id, page_no, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (type = 'click') AS BIGINT) AS clicks, CAST(count(*) FILTER (type = 'view') AS BIGINT) AS views FROM an GROUP BY 1, 2")
def annotation_summary(spark, d):
    s = O.annotation_summary(annotations(spark, d))
    return s.select("doc_id", "page_no", "total", F.coalesce(F.try_element_at("by_type", F.lit("click")), F.lit(0)).alias("clicks"), F.coalesce(F.try_element_at("by_type", F.lit("view")), F.lit(0)).alias("views"))


@query(f"WITH {AN} SELECT doc_id, page_no, idx, type, contents FROM an WHERE NOT (idx % 3 = 0 AND page_no < 2)")
def annotation_select(spark, d):
    a = annotations(spark, d)
    return O.annotation_select(a, a.where("idx % 3 = 0 and page_no < 2"), remove=True)[0].select("doc_id", "page_no", "idx", "type", "contents")


@query(f"WITH {AN} SELECT doc_id, page_no, idx, CASE WHEN idx % 2 = 0 AND k % 6 < 5 THEN 'red' ELSE stroke END AS stroke, fill, CASE WHEN idx % 2 = 0 AND k % 6 < 5 AND k > 50 THEN 2.5 ELSE border_width END AS border_width, CASE WHEN idx % 2 = 0 AND k % 6 < 5 THEN ['S', 'D', 'B', 'I', 'U'][k % 6 + 1] ELSE border_style END AS border_style FROM an")
def restyle_annotations(spark, d):
    a = annotations(spark, d)
    edits = a.where("idx % 2 = 0").select("doc_id", "page_no", "idx", F.lit("red").alias("stroke"), F.lit(None).cast("string").alias("fill"), F.when(F.col("k") > 50, 2.5).alias("border_width"), (F.col("k") % 6).alias("style"), F.lit(None).cast("double").alias("opacity"))
    return O.restyle_annotations(a, edits)[0].select("doc_id", "page_no", "idx", "stroke", "fill", "border_width", "border_style")


@query(f"WITH {PG}, {AN} SELECT doc_id, page_no, 'content' AS kind, text FROM pg UNION ALL SELECT doc_id, page_no, 'annotation', contents FROM an")
def flatten_annotations(spark, d):
    return O.flatten_annotations(conversation_pages(spark, d), annotations(spark, d))[0]


@query(f"WITH {AN} SELECT doc_id, page_no, CAST(count(*) AS BIGINT) AS n_comments, string_agg(contents, chr(10) ORDER BY ts, event_id) AS texts FROM an WHERE k % 4 <> 0 GROUP BY 1, 2")
def page_comments(spark, d):
    a = annotations(spark, d)
    return O.page_comments(a.select("doc_id", "page_no", "ts", F.col("event_id").alias("id"), F.when(F.col("k") % 4 == 0, F.lit(" ")).otherwise(F.col("contents")).alias("text")))


@query(f"WITH {IM} SELECT doc_id, page_no, idx, width, height, bits_per_component, CASE color_space WHEN 0 THEN 'DeviceGray' WHEN 1 THEN 'DeviceRGB' WHEN 2 THEN 'DeviceCMYK' WHEN 3 THEN 'Indexed' ELSE 'Unknown(' || color_space || ')' END AS color_space_name, coalesce(compression, 'None') AS compression, mask > 0 AS has_mask, size_bytes, CASE WHEN width > 0 AND height > 0 THEN floor(width * 1000.0::DOUBLE / height + 0.5) / 1000 END AS aspect_ratio FROM im")
def image_inventory(spark, d):
    return O.image_inventory(images(spark, d))


@query(f"WITH {IM} SELECT doc_id, page_no, CAST(count(*) AS BIGINT) AS n_images, string_agg(idx || ':' || width || 'x' || height, ',' ORDER BY idx) AS images FROM im GROUP BY 1, 2")
def images_by_page(spark, d):
    one = lambda x: F.concat(x["idx"].cast("string"), F.lit(":"), x["width"].cast("string"), F.lit("x"), x["height"].cast("string"))
    return O.images_by_page(images(spark, d)).withColumn("images", F.array_join(F.transform("images", one), ","))


@query(f"WITH {SP}, {IM} SELECT doc_id, page_no, block AS idx, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, 'text' AS type FROM sp GROUP BY 1, 2, 3 UNION ALL SELECT doc_id, page_no, idx, x0, y0, x1, y1, 'image' FROM im WHERE x1 IS NOT NULL")
def content_areas(spark, d):
    return O.content_areas(html_spans(table(spark, d, "pages")), images(spark, d))


@query(f"""WITH {PG}, z AS (SELECT doc_id, page_no, CAST(strlen(text) AS BIGINT) AS before, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[ \\t]+', ' ', 'g'))), lambda x: x <> '') AS l FROM pg),
y AS (SELECT doc_id, page_no, before, CAST(strlen(array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), chr(10))) AS BIGINT) AS after FROM z)
SELECT doc_id, page_no, before, after, before - after AS reduction, CASE WHEN before > 0 THEN floor((before - after) * 10000.0::DOUBLE / before + 0.5) / 100 ELSE 0 END AS percent FROM y""")
def optimize_report(spark, d):
    return O.optimize_report(conversation_pages(spark, d))


@query(f"""WITH {PG}, z AS (SELECT strlen(text) AS before, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[ \\t]+', ' ', 'g'))), lambda x: x <> '') AS l FROM pg),
y AS (SELECT count(*) AS n_pages, sum(before) AS before, sum(strlen(array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), chr(10)))) AS after FROM z)
SELECT CAST(n_pages AS BIGINT) AS n_pages, CAST(before AS BIGINT) AS before, CAST(after AS BIGINT) AS after, CAST(before - after AS BIGINT) AS reduction, floor((before - after) * 10000.0::DOUBLE / before + 0.5) / 100 AS percent FROM y""")
def optimize_total(spark, d):
    return O.optimize_total(O.optimize_report(conversation_pages(spark, d)))


VALUES = "va AS (SELECT CAST(n_nationkey AS BIGINT) AS doc_id, 'f' || n_nationkey AS name, n_name AS value FROM nation)"


def _values(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), F.concat(F.lit("f"), F.col("n_nationkey").cast("string")).alias("name"), F.col("n_name").alias("value"))


@query(f"WITH {FF}, {VALUES} SELECT ff.doc_id, ff.name, field_id, coalesce(va.value, ff.value) AS value, flags | 1 AS flags FROM ff LEFT JOIN va USING (doc_id, name)")
def fill_forms(spark, d):
    return O.fill_forms(form_fields(spark, d), _values(spark, d), lock=True)[0].select("doc_id", "name", "field_id", "value", "flags")


@query(f"WITH {FF}, {VALUES} SELECT 'fill_forms' AS op, doc_id, name AS item, 'unknown field' AS message FROM va WHERE NOT EXISTS (SELECT 1 FROM ff WHERE ff.doc_id = va.doc_id AND ff.name = va.name)")
def fill_forms_errors(spark, d):
    return O.fill_forms(form_fields(spark, d), _values(spark, d))[1]


@query("SELECT doc_id, 'New' AS title, CAST(NULL AS VARCHAR) AS author, source AS subject, CAST(3 AS BIGINT) AS n_keys FROM documents")
def edit_metadata(spark, d):
    props = F.create_map(F.lit("title"), F.lit("Old"), F.lit("author"), F.col("lang"), F.lit("subject"), F.col("source"))
    m = table(spark, d, "documents").select("doc_id", O.edit_metadata(props, {"title": "New", "subject": None}, clear_key="author").alias("m"))
    return m.select("doc_id", F.col("m")["title"].alias("title"), F.col("m")["author"].alias("author"), F.col("m")["subject"].alias("subject"), F.size("m").cast("long").alias("n_keys"))


@query(f"""WITH {PG}, {SP}, {IM}, {AN}, b AS (SELECT doc_id, page_no, count(DISTINCT block) AS n FROM sp GROUP BY 1, 2), i AS (SELECT doc_id, page_no, count(*) AS n FROM im GROUP BY 1, 2), a AS (SELECT doc_id, page_no, count(*) AS n FROM an GROUP BY 1, 2)
SELECT pg.doc_id, pg.page_no, CAST(coalesce(b.n, 0) AS BIGINT) AS n_blocks, CAST(coalesce(i.n, 0) AS BIGINT) AS n_images, CAST(coalesce(a.n, 0) AS BIGINT) AS n_annotations FROM pg LEFT JOIN b USING (doc_id, page_no) LEFT JOIN i USING (doc_id, page_no) LEFT JOIN a USING (doc_id, page_no) WHERE pg.page_no < 4""")
def object_tree(spark, d):
    return O.object_tree(conversation_pages(spark, d), html_spans(table(spark, d, "pages")), images(spark, d), annotations(spark, d), 4)


@query(f"""WITH {PG}, {SP}, {IM}, {AN}, b AS (SELECT doc_id, page_no, count(DISTINCT block) AS n FROM sp GROUP BY 1, 2), i AS (SELECT doc_id, page_no, count(*) AS n FROM im GROUP BY 1, 2), a AS (SELECT doc_id, page_no, count(*) AS n FROM an GROUP BY 1, 2)
SELECT pg.doc_id, pg.page_no, CAST(coalesce(b.n, 0) AS BIGINT) AS n_blocks, CAST(coalesce(i.n, 0) AS BIGINT) AS n_images, CAST(coalesce(a.n, 0) AS BIGINT) AS n_annotations FROM pg LEFT JOIN b USING (doc_id, page_no) LEFT JOIN i USING (doc_id, page_no) LEFT JOIN a USING (doc_id, page_no)""")
def object_tree_whole(spark, d):
    return O.object_tree(conversation_pages(spark, d), html_spans(table(spark, d, "pages")), images(spark, d), annotations(spark, d))


@query(f"WITH {PG} SELECT doc_id, CAST(count(*) AS BIGINT) AS n_pages, min(width) AS min_width, max(width) AS max_width, min(height + page_no) AS min_height, max(height + page_no) AS max_height FROM pg GROUP BY 1")
def page_profile(spark, d):
    pages = conversation_pages(spark, d)
    return O.page_profile(pages.withColumn("height", F.col("height") + F.col("page_no")))[1]


@query("SELECT doc_id, CAST(1 + doc_id % 4 AS DOUBLE) + (doc_id % 10) / 10.0::DOUBLE AS version FROM documents WHERE CAST(1 + doc_id % 4 AS DOUBLE) + (doc_id % 10) / 10.0::DOUBLE BETWEEN 1.4 AND 2.0")
def version_filter(spark, d):
    i = F.col("doc_id")
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("%PDF-"), (1 + i % 4).cast("string"), F.lit("."), (i % 10).cast("string")).alias("header"))
    return O.version_filter(docs).select("doc_id", "version")


@query(f"""WITH {CNT}, pr AS (SELECT doc_id AS pair_id, doc_id AS l, doc_id + 1 AS r FROM cnt WHERE doc_id % 2 = 0), ln AS (SELECT doc_id, page_no, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM pg),
a AS (SELECT pair_id, page_no, n, line FROM pr JOIN ln ON doc_id = l), b AS (SELECT pair_id, page_no, n, line FROM pr JOIN ln ON doc_id = r),
j AS (SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.page_no, b.page_no) AS page_no, a.line AS x, b.line AS y FROM a FULL OUTER JOIN b ON a.pair_id = b.pair_id AND a.page_no = b.page_no AND a.n = b.n)
SELECT pair_id, page_no, CAST(count(*) FILTER (x = y) AS BIGINT) AS n_same, CAST(count(*) FILTER (x <> y) AS BIGINT) AS n_changed, CAST(count(*) FILTER (x IS NULL) AS BIGINT) AS n_added, CAST(count(*) FILTER (y IS NULL) AS BIGINT) AS n_removed FROM j GROUP BY 1, 2""")
def compare_documents(spark, d):
    pages = conversation_pages(spark, d)
    pairs = P.page_counts(pages).where("doc_id % 2 = 0").select(F.col("doc_id").alias("pair_id"), F.col("doc_id").alias("left_id"), (F.col("doc_id") + 1).alias("right_id"))
    return O.comparison_summary(O.compare_documents(pairs, pages))
