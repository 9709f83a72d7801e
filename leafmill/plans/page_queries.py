"""Queries of page-set operators, over conversations read as documents and turns as pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.operators import pages as P
from leafmill.plans.base import CNT, PG, conversation_pages, query, requests, table
from leafmill.plans.layout_queries import ROMAN_SQL


@query(f"""WITH {CNT}, o AS (SELECT doc_id // 10 AS out_id, doc_id, n_pages, -doc_id AS pos FROM cnt), f AS (SELECT out_id, doc_id, coalesce(sum(n_pages) OVER (PARTITION BY out_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o)
SELECT f.out_id AS doc_id, pg.doc_id AS source_doc, page_no AS source_page, CAST(page_no + before AS INTEGER) AS page_no, text FROM pg JOIN f USING (doc_id)""")
def merge_documents(spark, d):
    pages = conversation_pages(spark, d)
    order = pages.select("doc_id").distinct().select(F.floor(F.col("doc_id") / 10).cast("long").alias("out_id"), "doc_id", (-F.col("doc_id")).alias("pos"))
    return P.merge_documents(pages, order)[0].select("doc_id", "source_doc", "source_page", "page_no", "text")


@query(f"WITH {CNT} SELECT pg.doc_id, r.part, CAST(page_no - r.lo AS INTEGER) AS page_no, text FROM pg JOIN cnt USING (doc_id) JOIN (VALUES (0, 0, 2), (1, 4, 4), (2, 1, 98)) r(part, lo, hi) ON page_no BETWEEN r.lo AND r.hi AND r.hi < n_pages")
def split_ranges(spark, d):
    return P.split_ranges(conversation_pages(spark, d), "1-3, 5,2-99").select("doc_id", "part", "page_no", "text")


@query(f"WITH {CNT} SELECT pg.doc_id, CAST(CASE page_no WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS INTEGER) AS page_no, text FROM pg JOIN cnt USING (doc_id) WHERE page_no IN (0, 1, 3) AND n_pages > 3")
def extract_pages(spark, d):
    return P.extract_pages(conversation_pages(spark, d), [3, 0, 1, 3])[0].select("doc_id", "page_no", "text")


@query(f"WITH {PG} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS page_no, page_no AS source_page, text FROM pg JOIN (VALUES (0, 2), (1, 0), (2, 0), (3, 9), (4, 5)) o(pos, p) ON p = page_no")
def organize_pages(spark, d):
    return P.organize_pages(conversation_pages(spark, d), [2, 0, 0, 9, 5]).select("doc_id", "page_no", "source_page", "text")


@query(f"WITH {PG} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page_no) - 1 AS INTEGER) AS page_no, text FROM pg WHERE page_no NOT IN (0, 2)")
def delete_pages(spark, d):
    return P.delete_pages(conversation_pages(spark, d), [0, 2])[0].select("doc_id", "page_no", "text")


@query(f"WITH {CNT} SELECT doc_id, CAST(page_no + CASE WHEN page_no >= CASE WHEN n_pages >= 3 THEN 3 ELSE n_pages END THEN 1 ELSE 0 END AS INTEGER) AS page_no, text FROM pg JOIN cnt USING (doc_id) UNION ALL SELECT doc_id, CAST(CASE WHEN n_pages >= 3 THEN 3 ELSE n_pages END AS INTEGER), '' FROM cnt")
def insert_pages(spark, d):
    pages = conversation_pages(spark, d)
    return P.insert_pages(pages, P.blank_pages(pages), 3).select("doc_id", "page_no", "text")


@query(f"WITH {CNT} SELECT doc_id, CAST(page_no + CASE WHEN n_pages > 1 AND page_no >= 2 THEN 1 ELSE 0 END AS INTEGER) AS page_no, text FROM pg JOIN cnt USING (doc_id) UNION ALL SELECT doc_id, CAST(2 AS INTEGER), text FROM pg WHERE page_no = 1")
def duplicate_page(spark, d):
    return P.duplicate_page(conversation_pages(spark, d), 1)[0].select("doc_id", "page_no", "text")


@query(f"WITH {CNT} SELECT doc_id, CAST(CASE WHEN n_pages <= 3 THEN page_no WHEN page_no = 3 THEN 0 WHEN page_no < 3 THEN page_no + 1 ELSE page_no END AS INTEGER) AS page_no, text FROM pg JOIN cnt USING (doc_id)")
def move_page(spark, d):
    return P.move_page(conversation_pages(spark, d), 3, 0).select("doc_id", "page_no", "text")


@query(f"WITH {PG} SELECT doc_id, page_no, CAST(CASE WHEN page_no IN (0, 2) THEN 270 ELSE 180 END AS INTEGER) AS rotation FROM pg")
def rotate_pages(spark, d):
    return P.rotate_pages(P.rotate_pages(conversation_pages(spark, d), 180, absolute=True), -270, [0, 2]).select("doc_id", "page_no", "rotation")


@query(f"WITH {PG} SELECT doc_id, page_no, CAST(CASE doc_id % 4 WHEN 0 THEN 842 WHEN 1 THEN 612 WHEN 2 THEN 595 ELSE 595 END AS DOUBLE) AS width, CAST(CASE doc_id % 4 WHEN 0 THEN 1191 WHEN 1 THEN 1008 WHEN 2 THEN 842 ELSE 842 END AS DOUBLE) AS height FROM pg")
def resize_pages(spark, d):
    k = F.col("doc_id") % 4
    return P.resize_pages(conversation_pages(spark, d), F.when(k == 0, "A3").when(k == 1, "Legal").when(k == 2, "A4").otherwise("nothing")).select("doc_id", "page_no", "width", "height")


@query(f"WITH {PG} SELECT doc_id, page_no, CAST(page_no * 100 AS DOUBLE) AS x0, CAST(10 AS DOUBLE) AS y0, CAST(495 AS DOUBLE) AS x1, CAST(832 AS DOUBLE) AS y1 FROM pg WHERE page_no * 100 < 495")
def crop_pages(spark, d):
    left = (F.col("page_no") * 100).cast("double")
    return P.crop_pages(conversation_pages(spark, d), left, F.lit(10.0), F.lit(100.0), F.lit(10.0))[0].select("doc_id", "page_no", "x0", "y0", "x1", "y1")


@query(f"""WITH {PG}, b AS (SELECT doc_id, page_no FROM pg WHERE page_no % 3 = 1 AND NOT (doc_id % 2 = 0 AND page_no = 1))
SELECT pg.doc_id, array_to_string(coalesce((SELECT list(page_no ORDER BY page_no) FROM b WHERE b.doc_id = pg.doc_id), []), ',') AS removed, CAST(count(*) - (SELECT count(*) FROM b WHERE b.doc_id = pg.doc_id) AS BIGINT) AS n_left FROM pg GROUP BY pg.doc_id""")
def remove_blank_pages(spark, d):
    pages = conversation_pages(spark, d).withColumn("text", F.when(F.col("page_no") % 3 == 1, " \n\t").otherwise(F.col("text")))
    images = pages.where("doc_id % 2 = 0 and page_no = 1").select("doc_id", "page_no")
    return P.remove_blank_pages(pages, images)[1].select("doc_id", F.array_join(F.transform("removed", lambda x: x.cast("string")), ",").alias("removed"), "n_left")


@query(f"""WITH {CNT}, t AS (SELECT doc_id, coalesce(sum(n_pages) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, n_pages FROM cnt)
SELECT doc_id, page_no, 'A-' || lower({ROMAN_SQL}) || '.' AS label, 'Page ' || (page_no + 1) || ' of ' || n_pages AS footer, CAST(before + page_no + 1 AS BIGINT) AS corpus_no FROM (SELECT *, CAST(page_no + 7 AS INTEGER) AS n FROM pg JOIN t USING (doc_id))""")
def page_labels(spark, d):
    pages = P.page_labels(conversation_pages(spark, d), "roman_lower", "A-", ".", 7)
    return P.corpus_numbers(P.page_templates(pages, footer="Page {page} of {total}")).select("doc_id", "page_no", "label", "footer", "corpus_no")


#: A fold over a list of one-element lists: the accumulator and what is added have the same type.
REPLAY = """WITH RECURSIVE c AS (SELECT conv_id AS doc_id, count(*) AS n FROM conversations GROUP BY 1),
op AS (SELECT user_id AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS s, CAST(json_extract(props, '$.k') AS INTEGER) AS arg, CASE event_type WHEN 'view' THEN 'delete' WHEN 'click' THEN 'duplicate' WHEN 'purchase' THEN 'to_front' ELSE 'none' END AS kind FROM events),
r(doc_id, s, ids) AS (SELECT c.doc_id, 0::BIGINT, list_transform(range(n), lambda x: CAST(x AS INTEGER)) FROM c WHERE doc_id IN (SELECT doc_id FROM op)
 UNION ALL SELECT r.doc_id, op.s, CASE WHEN kind = 'delete' AND len(ids) > 1 THEN ids[1:arg % len(ids)] || ids[arg % len(ids) + 2:] WHEN kind = 'duplicate' THEN ids[1:arg % len(ids) + 1] || ids[arg % len(ids) + 1:] WHEN kind = 'to_front' THEN [ids[arg % len(ids) + 1]] || ids[1:arg % len(ids)] || ids[arg % len(ids) + 2:] ELSE ids END FROM r JOIN op ON op.doc_id = r.doc_id AND op.s = r.s + 1)
SELECT doc_id, array_to_string(arg_max(ids, s), ',') AS pages FROM r GROUP BY 1"""


@query(REPLAY)
def replay_page_ops(spark, d):
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type") == "view", "delete").when(F.col("event_type") == "click", "duplicate").when(F.col("event_type") == "purchase", "to_front").otherwise("none")
    log = e.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"), kind.alias("kind"), F.get_json_object("props", "$.k").cast("int").alias("arg"))
    return P.replay_page_ops(P.page_counts(conversation_pages(spark, d)), log)[0].select("doc_id", F.array_join(F.transform("pages", lambda x: x.cast("string")), ",").alias("pages"))


@query("""WITH RECURSIVE op AS (SELECT user_id AS session, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS s, event_id AS state, CASE event_type WHEN 'view' THEN 'undo' WHEN 'error' THEN 'redo' ELSE 'edit' END AS kind FROM events),
r(session, s, st, cur) AS (SELECT DISTINCT session, 0::BIGINT, CAST([] AS BIGINT[]), -1::BIGINT FROM op
 UNION ALL SELECT r.session, op.s, CASE WHEN kind = 'edit' THEN (st[1:cur + 1] || [state])[greatest(cur + 2 - 5, 0) + 1:] ELSE st END,
  CASE kind WHEN 'edit' THEN least(cur + 1, 4) WHEN 'undo' THEN greatest(cur - 1, least(0, len(st) - 1)) ELSE least(cur + 1, len(st) - 1) END FROM r JOIN op ON op.session = r.session AND op.s = r.s + 1)
SELECT session, CAST(len(arg_max(st, s)) AS BIGINT) AS n_states, CAST(arg_max(cur, s) AS BIGINT) AS cursor, CASE WHEN arg_max(cur, s) >= 0 THEN arg_max(st, s)[arg_max(cur, s) + 1] END AS current FROM r GROUP BY 1""")
def replay_history(spark, d):
    r = requests(spark, d)
    kind = F.when(F.col("path") == "view", "undo").when(F.col("path") == "error", "redo").otherwise("edit")
    return P.replay_history(r.select(F.col("client").alias("session"), F.col("id").alias("seq"), kind.alias("kind"), F.col("id").alias("state")), keep=5)
