"""Queries of text and navigation operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.operators import navigation as N
from leafmill.operators import text as T
from leafmill.operators.layout import html_spans
from leafmill.plans.base import CNT, PG, SP, SPB, conversation_pages, query, table


def _spans(spark, d):
    return html_spans(table(spark, d, "pages"))


def _bold_spans(spark, d):
    """For queries that tell fonts apart."""
    return html_spans(table(spark, d, "pages"), bold=True)


@query(f"WITH {SP} SELECT doc_id, string_agg(text || ' ' || chr(10), '' ORDER BY page_no, block) AS text FROM sp WHERE page_no < 1 GROUP BY 1")
def extract_text(spark, d):
    return T.extract_text(_spans(spark, d), 1)


@query(f"WITH {SP} SELECT doc_id, string_agg(text || ' ' || chr(10), '' ORDER BY page_no, block) AS text FROM sp GROUP BY 1")
def extract_text_whole(spark, d):
    return T.extract_text(_spans(spark, d))


@query(f"WITH {SPB} SELECT doc_id, page_no, block, line, span, text, font, size, flags & 16 > 0 AS is_bold, flags & 64 > 0 AS is_italic, flags & 1 > 0 AS is_serif, flags & 8 > 0 AS is_mono FROM sp")
def text_properties(spark, d):
    return T.text_properties(_bold_spans(spark, d))


@query(f"""WITH {SP}, h AS (SELECT doc_id, page_no, block, size, x0, y0, y1, unnest(list_filter(range(len(text)), lambda p: substring(text, p + 1, 3) = 'ere')) AS pos FROM (SELECT * FROM sp WHERE contains(text, 'ere')))
SELECT doc_id, page_no, CAST(row_number() OVER (PARTITION BY doc_id, page_no ORDER BY block, pos) - 1 AS INTEGER) AS idx, x0 + pos * size * 0.5 AS hx0, y0 AS hy0, x0 + pos * size * 0.5 + 3 * size * 0.5 AS hx1, y1 AS hy1 FROM h""")
def search_text(spark, d):
    return T.search_text(_spans(spark, d), " ere ").drop("corners")


#: Terms: the first word of each benchmark item, and in whole documents the items themselves and their first five words.
@query(f"""WITH {PG}, q AS (SELECT item_id AS query_id, split_part(text, ' ', 1) AS query FROM benchmark),
h AS (SELECT doc_id, page_no, query_id, query, text, unnest(list_filter(range(length(text)), lambda p: substring(text, p + 1, length(query)) = query)) AS pos FROM pg JOIN q ON contains(text, query))
SELECT doc_id, page_no, query_id, CAST(pos AS INTEGER) AS "at", substring(text, greatest(pos - 50, 0) + 1, least(pos, 50)) AS before, query AS match, substring(text, pos + length(query) + 1, 50) AS after FROM h""")
def search_context(spark, d):
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.split("text", " ").getItem(0).alias("query"))
    return T.search_context(conversation_pages(spark, d), queries)


@query("""WITH q AS (SELECT item_id AS query_id, text AS query FROM benchmark UNION ALL SELECT item_id, array_to_string(string_split(text, ' ')[1:5], ' ') FROM benchmark),
h AS (SELECT doc_id, query_id, query, text, position(query IN text) AS first FROM documents JOIN q ON contains(text, query)),
p AS (SELECT *, unnest(list_filter(range(first - 1, length(text)), lambda p: substring(text, p + 1, length(query)) = query)) AS pos FROM h)
SELECT doc_id, CAST(0 AS INTEGER) AS page_no, query_id, CAST(pos AS INTEGER) AS "at", substring(text, greatest(pos - 50, 0) + 1, least(pos, 50)) AS before, query AS match, substring(text, pos + length(query) + 1, 50) AS after FROM p""")
def search_context_items(spark, d):
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    starts = items.withColumn("query", F.array_join(F.slice(F.split("query", " "), 1, 5), " "))
    return T.search_context(table(spark, d, "documents").select("doc_id", F.lit(0).alias("page_no"), "text"), items.unionByName(starts))


@query(f"""WITH {SPB} SELECT doc_id, page_no, block, replace(text, 'the', 'THE!') AS text, font, 50 + length(replace(text, 'the', 'THE!')) * size * 0.5 AS x1 FROM sp""")
def replace_text(spark, d):
    return T.replace_text(_bold_spans(spark, d), "the", "THE!")[0].select("doc_id", "page_no", "block", "text", "font", "x1")


@query(f"""WITH {SP}, h AS (SELECT doc_id, page_no, block, size, x0, y0, y1, string_split(text, 'the') AS l FROM sp WHERE contains(text, 'the')),
k AS (SELECT *, unnest(range(1, len(l))) AS n FROM h), b AS (SELECT *, list_sum(list_transform(l[1:n], lambda x: length(x))) + 3 * (n - 1) AS off FROM k),
r AS (SELECT doc_id, page_no, CAST(row_number() OVER (PARTITION BY doc_id, page_no ORDER BY block, n) - 1 AS INTEGER) AS idx, x0 + off * size * 0.5 AS hx0, y0 AS hy0, x0 + off * size * 0.5 + 3 * size * 0.5 AS hx1, y1 AS hy1 FROM b),
f AS (SELECT r.doc_id, r.page_no, r.idx, arg_min(font, block) AS font, arg_min(size, block) AS size FROM r JOIN sp ON sp.doc_id = r.doc_id AND sp.page_no = r.page_no AND (hx0 + hx1) / 2 BETWEEN x0 AND x1 AND (hy0 + hy1) / 2 BETWEEN y0 AND y1 GROUP BY 1, 2, 3)
SELECT r.*, coalesce(font, 'Helvetica') AS font, coalesce(size, 12) AS size FROM r LEFT JOIN f USING (doc_id, page_no, idx)""")
def replaced_areas(spark, d):
    return T.replaced_areas(_spans(spark, d), "the")


@query(f"""WITH {SPB}, g AS (SELECT doc_id, page_no, font, size, CAST(sum(length(text)) AS BIGINT) AS char_count, arg_min(flags, block) AS flags FROM sp GROUP BY 1, 2, 3, 4), t AS (SELECT *, CAST(sum(char_count) OVER (PARTITION BY doc_id, page_no) AS BIGINT) AS page_chars FROM g)
SELECT doc_id, page_no, font, size, char_count, flags & 16 > 0 AS is_bold, flags & 64 > 0 AS is_italic, page_chars, floor(char_count * 10000.0::DOUBLE / page_chars + 0.5) / 100 AS percentage FROM t""")
def font_usage(spark, d):
    return T.font_usage(_bold_spans(spark, d))


@query(f"WITH {SPB} SELECT doc_id, font, array_to_string(list_sort(list(DISTINCT page_no)), ',') AS pages FROM sp GROUP BY 1, 2")
def document_fonts(spark, d):
    return T.document_fonts(_bold_spans(spark, d)).withColumn("pages", F.array_join(F.transform("pages", lambda x: x.cast("string")), ","))


PART_FONT = "CASE p_partkey % 11 WHEN 0 THEN 'Arial-Bold' WHEN 1 THEN 'Times New Roman ' || p_brand WHEN 2 THEN 'X+Helvetica-Bold' WHEN 3 THEN 'Fira Mono' WHEN 4 THEN p_name || ' Italic' WHEN 5 THEN 'My Bold Oblique' WHEN 6 THEN 'Palatino Linotype' WHEN 7 THEN 'Bookman-Bold Italic' WHEN 8 THEN 'Bold Serif Italic' WHEN 9 THEN 'Noto Serif' ELSE p_name END"


@query(f"""WITH f AS (SELECT p_partkey, {PART_FONT} AS font FROM part), n AS (SELECT *, lower(replace(replace(font, '-', ''), ' ', '')) AS k FROM f)
SELECT p_partkey, font, CASE WHEN k LIKE '%timesroman%' THEN 'Times-Roman' WHEN k LIKE '%timesbold%' THEN 'Times-Bold' WHEN k LIKE '%timesitalic%' THEN 'Times-Italic' WHEN k LIKE '%helvetica%' THEN 'Helvetica' WHEN k LIKE '%courier%' THEN 'Courier' WHEN k LIKE '%symbol%' THEN 'Symbol' WHEN k LIKE '%zapfdingbats%' THEN 'ZapfDingbats'
 WHEN k LIKE '%times%' THEN 'Times-Roman' WHEN k LIKE '%arial%' THEN 'Helvetica' WHEN k LIKE '%verdana%' THEN 'Helvetica' WHEN k LIKE '%georgia%' OR k LIKE '%palatino%' OR k LIKE '%bookman%' THEN 'Times-Roman'
 WHEN k LIKE '%bold%' THEN CASE WHEN k LIKE '%italic%' THEN 'Helvetica-BoldOblique' ELSE 'Helvetica-Bold' END WHEN k LIKE '%italic%' OR k LIKE '%oblique%' THEN 'Helvetica-Oblique' WHEN k LIKE '%mono%' THEN 'Courier' WHEN k LIKE '%serif%' THEN 'Times-Roman' ELSE 'Helvetica' END AS match FROM n""")
def match_font(spark, d):
    return T.match_font(table(spark, d, "part").select("p_partkey", F.expr(PART_FONT).alias("font")))


@query(f"""WITH {SPB}, p AS (SELECT event_id AS point_id, event_id % 250 AS doc_id, 0 AS page_no, 50 + value AS x, CAST(45 + 2 * CAST(json_extract(props, '$.k') AS INTEGER) AS DOUBLE) AS y FROM events),
b AS (SELECT point_id, arg_min(font, block) AS font, arg_min(size, block) AS size FROM p JOIN sp ON p.doc_id = sp.doc_id AND p.page_no = sp.page_no AND x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY 1) SELECT p.point_id, p.doc_id, p.page_no, b.font, b.size FROM p LEFT JOIN b USING (point_id)""")
def font_at_points(spark, d):
    e = table(spark, d, "events")
    points = e.select(F.col("event_id").alias("point_id"), (F.col("event_id") % 250).alias("doc_id"), F.lit(0).alias("page_no"), (50 + F.col("value")).alias("x"), (45 + 2 * F.get_json_object("props", "$.k").cast("int")).cast("double").alias("y"))
    return T.font_at_points(_bold_spans(spark, d), points)


TOC = SP + """, toc AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page_no, block) - 1 AS INTEGER) AS idx, CAST(CASE WHEN size >= 18 THEN 1 WHEN size >= 14 THEN 2 ELSE 3 END AS INTEGER) AS level, substring(trim(text), 1, 50) AS title, CAST(page_no + 1 AS INTEGER) AS page FROM sp WHERE size >= 11)"""


def _toc(spark, d):
    return T.auto_toc(_spans(spark, d), (18, 14, 11))


@query(f"WITH {TOC} SELECT * FROM toc")
def auto_toc(spark, d):
    return _toc(spark, d)


@query(f"""WITH {SP}, r AS (SELECT event_id % 250 AS doc_id, CAST(json_extract(props, '$.k') AS INTEGER) * 5 AS a FROM events WHERE event_type = 'error') SELECT doc_id, page_no, block, text FROM sp WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = sp.doc_id AND sp.page_no = 0 AND x0 < 80 AND x1 > 0 AND y0 < a + 20 AND y1 > a)""")
def redact_regions(spark, d):
    e = table(spark, d, "events").where("event_type = 'error'")
    a = F.get_json_object("props", "$.k").cast("int") * 5
    regions = e.select((F.col("event_id") % 250).alias("doc_id"), F.lit(0).alias("page_no"), F.lit(0.0).alias("rx0"), a.cast("double").alias("ry0"), F.lit(80.0).alias("rx1"), (a + 20).cast("double").alias("ry1"))
    return T.redact_regions(_spans(spark, d), regions)[0].select("doc_id", "page_no", "block", "text")


@query(r"SELECT page_id, regexp_replace(html, '<[^<]+?>', '', 'g') AS text FROM pages")
def strip_html(spark, d):
    return table(spark, d, "pages").select("page_id", T.strip_html(F.col("html")).alias("text"))


@query(r"SELECT doc_id, substring(regexp_replace(text || chr(7) || 'end', '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g'), 1, 1000) AS text FROM documents")
def sanitize_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.sanitize_text(F.concat("text", F.lit("\x07end"))).alias("text"))


@query(f"WITH {TOC} SELECT *, CASE WHEN page > 0 THEN 'page' ELSE 'none' END AS link_type FROM toc")
def toc_entries(spark, d):
    return N.toc_entries(_toc(spark, d))


ENTRIES = "en AS (SELECT user_id AS doc_id, event_id AS idx, CASE WHEN event_id % 3 > 0 THEN 1 + event_id % 3 END AS level, CASE WHEN event_id % 5 > 0 THEN event_type END AS title, CAST(json_extract(props, '$.k') AS INTEGER) % 8 AS page FROM events)"


def _entries(spark, d):
    i = F.col("event_id")
    return table(spark, d, "events").select(F.col("user_id").alias("doc_id"), i.alias("idx"), F.when(i % 3 > 0, 1 + i % 3).cast("int").alias("level"), F.when(i % 5 > 0, F.col("event_type")).alias("title"), (F.get_json_object("props", "$.k").cast("int") % 8).alias("page"))


@query(f"WITH {CNT}, {ENTRIES} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1 AS INTEGER) AS idx, CAST(coalesce(level, 1) AS INTEGER) AS level, coalesce(title, '') AS title, CAST(page AS INTEGER) AS page FROM en JOIN cnt USING (doc_id) WHERE page BETWEEN 1 AND n_pages")
def set_toc(spark, d):
    return N.set_toc(_entries(spark, d), conversation_pages(spark, d))[0]


@query(f"WITH {CNT}, {ENTRIES} SELECT 'set_toc' AS op, doc_id, CAST(idx AS VARCHAR) AS item, 'Item ' || idx || ': Invalid page number ' || page AS message FROM en JOIN cnt USING (doc_id) WHERE NOT page BETWEEN 1 AND n_pages")
def set_toc_errors(spark, d):
    return N.set_toc(_entries(spark, d), conversation_pages(spark, d))[1]


EDITS = "ed AS (SELECT user_id AS doc_id, event_id AS seq, CASE event_type WHEN 'view' THEN 'add' WHEN 'click' THEN 'update' WHEN 'signup' THEN 'delete' END AS kind, CAST(json_extract(props, '$.k') AS INTEGER) % 9 AS idx, CASE WHEN event_id % 2 = 0 THEN 2 END AS level, CASE WHEN event_id % 7 > 0 THEN 'T' || event_id END AS title, CASE WHEN event_id % 3 > 0 THEN 1 + event_id % 3 END AS page FROM events WHERE event_type IN ('view', 'click', 'signup'))"


@query(f"""WITH {TOC}, pc AS (SELECT doc_id, 2 AS n_pages FROM (SELECT DISTINCT doc_id FROM toc)), {EDITS}, sz AS (SELECT doc_id, count(*) AS n_toc FROM toc GROUP BY 1),
j AS (SELECT ed.*, n_pages, n_toc FROM ed LEFT JOIN pc USING (doc_id) LEFT JOIN sz USING (doc_id)),
ok AS (SELECT * FROM j WHERE CASE WHEN kind = 'add' AND coalesce(trim(title), '') = '' THEN false WHEN kind = 'add' AND page IS NULL THEN false WHEN page IS NOT NULL AND NOT coalesce(page BETWEEN 1 AND n_pages, false) THEN false WHEN kind <> 'add' AND NOT coalesce(idx BETWEEN 0 AND coalesce(n_toc, 0) - 1, false) THEN false ELSE true END),
up AS (SELECT doc_id, idx, arg_max(struct_pack(l := level, t := title, p := page), seq) AS u FROM ok WHERE kind = 'update' GROUP BY 1, 2),
old AS (SELECT doc_id, 0 AS new, idx AS k, coalesce(u.l, level) AS level, coalesce(u.t, title) AS title, coalesce(u.p, page) AS page FROM toc LEFT JOIN up USING (doc_id, idx) WHERE NOT EXISTS (SELECT 1 FROM ok WHERE kind = 'delete' AND ok.doc_id = toc.doc_id AND ok.idx = toc.idx)),
al AS (SELECT * FROM old UNION ALL SELECT doc_id, 1, seq, coalesce(level, 1), title, page FROM ok WHERE kind = 'add')
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY new, k) - 1 AS INTEGER) AS idx, CAST(level AS INTEGER) AS level, title, CAST(page AS INTEGER) AS page FROM al""")
def edit_bookmarks(spark, d):
    toc = _toc(spark, d)
    two = toc.select("doc_id").distinct().select("doc_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("page_no"))
    i = F.col("event_id")
    kind = F.when(F.col("event_type") == "view", "add").when(F.col("event_type") == "click", "update").when(F.col("event_type") == "signup", "delete")
    edits = table(spark, d, "events").select(F.col("user_id").alias("doc_id"), i.alias("seq"), kind.alias("kind"), (F.get_json_object("props", "$.k").cast("int") % 9).alias("idx"), F.when(i % 2 == 0, 2).alias("level"), F.when(i % 7 > 0, F.concat(F.lit("T"), i.cast("string"))).alias("title"), F.when(i % 3 > 0, 1 + i % 3).cast("int").alias("page")).where("kind is not null")
    return N.edit_bookmarks(toc, edits, two)[0]


@query(f"WITH {TOC} SELECT * FROM toc WHERE page = 1")
def bookmarks_by_page(spark, d):
    spans = _spans(spark, d)
    return N.bookmarks_by_page(_toc(spark, d), spans.select("doc_id", "page_no").distinct(), 0)


HREFS = r"""lk AS (SELECT doc_id, CAST(i AS INTEGER) AS idx, target, CASE WHEN target LIKE 'http:%' OR target LIKE 'https:%' OR target LIKE 'mailto:%' THEN 'uri' WHEN starts_with(target, '#') THEN 'named' WHEN starts_with(target, 'file:') THEN 'file' WHEN target <> '' THEN 'internal' ELSE 'unknown' END AS type
 FROM (SELECT page_id AS doc_id, unnest(h) AS target, unnest(range(len(h))) AS i FROM (SELECT page_id, list_transform(regexp_extract_all(html, '(?i)<a\s(?:[^>]*\s)?href\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1), lambda t: trim(t, chr(34) || chr(39))) AS h FROM pages)))"""


@query(f"WITH {HREFS} SELECT * FROM lk")
def page_links(spark, d):
    return N.page_links(table(spark, d, "pages"))


LINKS = "ln AS (SELECT user_id AS doc_id, CAST(json_extract(props, '$.k') AS INTEGER) % 4 AS page_no, CAST(row_number() OVER (PARTITION BY user_id, CAST(json_extract(props, '$.k') AS INTEGER) % 4 ORDER BY event_id) - 1 AS INTEGER) AS idx, CASE WHEN event_type = 'error' THEN 'uri' ELSE 'internal' END AS type, CASE WHEN event_type = 'error' THEN 'http://x/' || event_id END AS uri, CASE WHEN event_type <> 'error' THEN CAST(json_extract(props, '$.k') AS INTEGER) % 10 END AS dest_page, CAST(value AS DOUBLE) AS x0, CAST(0 AS DOUBLE) AS y0, value + 10 AS x1, CAST(5 AS DOUBLE) AS y1, event_id FROM events)"


def _links(spark, d):
    from pyspark.sql import Window as W

    k = F.get_json_object("props", "$.k").cast("int")
    e = table(spark, d, "events").select("*", k.alias("k"), (k % 4).alias("page_no"))
    bad = F.col("event_type") == "error"
    idx = F.row_number().over(W.partitionBy("user_id", "page_no").orderBy("event_id")) - 1
    return e.select(F.col("user_id").alias("doc_id"), "page_no", idx.alias("idx"), F.when(bad, "uri").otherwise("internal").alias("type"), F.when(bad, F.concat(F.lit("http://x/"), F.col("event_id").cast("string"))).alias("uri"), F.when(~bad, F.col("k") % 10).alias("dest_page"), F.col("value").alias("x0"), F.lit(0.0).alias("y0"), (F.col("value") + 10).alias("x1"), F.lit(5.0).alias("y1"))


@query(f"""WITH {CNT}, {LINKS}, ad AS (SELECT conv_id AS doc_id, CAST(turn AS INTEGER) AS page_no, conv_id * 100 + turn AS seq, CASE WHEN turn % 2 = 0 THEN 'u' || turn END AS uri, CASE WHEN turn % 3 > 0 THEN turn END AS dest_page FROM conversations),
ok AS (SELECT ad.* FROM ad LEFT JOIN cnt USING (doc_id) WHERE uri IS NOT NULL OR coalesce(dest_page BETWEEN 1 AND n_pages, false)),
al AS (SELECT doc_id, page_no, 0 AS new, idx AS k, type, uri, dest_page, x0, y0, x1, y1 FROM ln WHERE NOT (idx = 1 AND page_no = 2) UNION ALL SELECT doc_id, page_no, 1, seq, CASE WHEN uri IS NOT NULL THEN 'uri' ELSE 'internal' END, uri, CASE WHEN uri IS NULL THEN dest_page - 1 END, 1, 2, 4, 6 FROM ok)
SELECT doc_id, page_no, type, uri, CAST(dest_page AS BIGINT) AS dest_page, x0, y0, x1, y1, CAST(row_number() OVER (PARTITION BY doc_id, page_no ORDER BY new, k) - 1 AS INTEGER) AS idx FROM al""")
def edit_links(spark, d):
    c = table(spark, d, "conversations")
    t = F.col("turn")
    add = c.select(F.col("conv_id").alias("doc_id"), t.cast("int").alias("page_no"), (F.col("conv_id") * 100 + t).alias("seq"), F.when(t % 2 == 0, F.concat(F.lit("u"), t.cast("string"))).alias("uri"), F.when(t % 3 > 0, t).alias("dest_page"), F.lit(1).alias("x"), F.lit(2).alias("y"), F.lit(3).alias("w"), F.lit(4).alias("h"))
    links = _links(spark, d)
    remove = links.where("page_no = 2 and idx = 1").select("doc_id", "page_no", "idx")
    return N.edit_links(links, add, remove, conversation_pages(spark, d))[0].select("doc_id", "page_no", "type", "uri", F.col("dest_page").cast("long").alias("dest_page"), "x0", "y0", "x1", "y1", "idx")


@query(f"WITH {PG}, {LINKS} SELECT doc_id, page_no, CAST(count(*) FILTER (idx > 1) AS BIGINT) AS n_left FROM ln GROUP BY 1, 2 HAVING count(*) FILTER (idx <= 1) > 0")
def links_left(spark, d):
    links = _links(spark, d)
    return N.links_left(links, links.where("idx <= 1"))


@query(f"WITH {PG}, {LINKS} SELECT ln.doc_id, ln.page_no, ln.idx, ln.dest_page FROM ln WHERE type = 'internal' AND NOT EXISTS (SELECT 1 FROM pg WHERE pg.doc_id = ln.doc_id AND pg.page_no = ln.dest_page)")
def broken_links(spark, d):
    return N.broken_links(_links(spark, d), conversation_pages(spark, d)).select("doc_id", "page_no", "idx", "dest_page")
