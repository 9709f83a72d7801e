"""Queries of sources, layout and exports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from leafmill.functions import scalars as S
from leafmill.operators import layout as L
from leafmill.plans.base import FF, HPB, PG, PT, SP, SPB, WL, conversation_pages, form_fields, query, table
from leafmill.sources import exports as X
from leafmill.sources import scans as C
from leafmill.sources.kept import file_system, shared_folder


@query()
def scan_files(spark, d):
    """The table files of the folder: SQL on the tables can't see them."""
    return C.scan_files(spark, d, "*.parquet", at_least=2).select(F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), F.col("length").alias("bytes"))


@query(r"SELECT doc_id, CAST(i AS INTEGER) AS line_no, line FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents)")
def scan_text(spark, d):
    return C.scan_text(table(spark, d, "documents"))


def _as_csv(spark, df):
    """A table written as CSV files with a header and quoted cells to the shared folder; the path."""
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    df.write.option("header", True).option("escape", '"').csv(path)
    system, at = file_system(spark, path)
    system.deleteOnExit(at)
    return path


@query("SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, typeof(1) = 'INTEGER' AS key_is_int, o_totalprice, true AS price_is_double, 'a, \"b\": ' || o_orderpriority AS note FROM orders")
def scan_csv(spark, d):
    """Orders as CSV files, read back with the types that are found in them."""
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.concat(F.lit('a, "b": '), "o_orderpriority").alias("note"))
    back = C.scan_csv(spark, _as_csv(spark, o))
    kinds = dict(back.dtypes)
    whole, real = F.lit(kinds["o_orderkey"] in ("int", "bigint")), F.lit(kinds["o_totalprice"] == "double")
    return back.select(F.col("o_orderkey").cast("string").alias("o_orderkey"), whole.alias("key_is_int"), "o_totalprice", real.alias("price_is_double"), "note")


@query("SELECT o_orderkey, o_orderstatus, 'a, \"b\": ' || o_orderpriority AS note FROM orders")
def scan_csv_files(spark, d):
    """Orders as CSV files, read back with a schema."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.concat(F.lit('a, "b": '), "o_orderpriority").alias("note"))
    return C.scan_csv(spark, _as_csv(spark, o), o.schema)


@query("""SELECT event_id AS doc_id, 0 AS row_no, 'k' AS key, json_extract_string(props, '$.k') AS value FROM events
UNION ALL SELECT event_id, 1, 'k', '' FROM events UNION ALL SELECT event_id, 0, 't', '' FROM events UNION ALL SELECT event_id, 1, 't', event_type FROM events""")
def scan_json(spark, d):
    e = table(spark, d, "events")
    return C.scan_json(e.select(F.col("event_id").alias("doc_id"), F.concat(F.lit("["), "props", F.lit(', {"t": "'), "event_type", F.lit('"}]')).alias("payload")))


@query(f"WITH {HPB} SELECT doc_id, i, tag, text FROM hp")
def scan_html(spark, d):
    return L.scan_html(table(spark, d, "pages"), bold=True)


@query("""WITH l AS (SELECT conv_id * 100 + turn AS doc_id, unnest(string_split('# ' || text, chr(10))) AS raw, unnest(range(len(string_split('# ' || text, chr(10))))) AS i FROM conversations)
SELECT doc_id, CAST(i AS INTEGER) AS i, CASE WHEN i = 0 THEN 'h1' ELSE 'p' END AS tag, trim(CASE WHEN i = 0 THEN substring(raw, 3) ELSE raw END) AS text FROM l WHERE trim(raw) <> ''""")
def scan_markdown(spark, d):
    c = table(spark, d, "conversations")
    return L.scan_markdown(c.select((F.col("conv_id") * 100 + F.col("turn")).alias("doc_id"), F.concat(F.lit("# "), "text").alias("text")))


@query("""SELECT path, length, CASE WHEN NOT ends_with(lower(path), '.pdf') THEN 'wrong extension' WHEN length = 0 THEN 'empty file' WHEN length > 5000 THEN 'too large' WHEN NOT starts_with(body, '%PDF-') THEN 'bad signature'
 WHEN NOT (kind = 'application/pdf' OR starts_with(kind, 'text/')) THEN 'content type not allowed' END AS reject_reason
FROM (SELECT doc_id || CASE WHEN doc_id % 5 = 0 THEN '.txt' ELSE '.PDF' END AS path, CASE WHEN doc_id % 7 = 0 THEN text ELSE '%PDF-1.7' || text END AS body, CAST(strlen(CASE WHEN doc_id % 7 = 0 THEN text ELSE '%PDF-1.7' || text END) AS BIGINT) AS length,
 CASE doc_id % 3 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'text/plain' ELSE 'image/png' END AS kind FROM documents)""")
def ingest_gate(spark, d):
    t = table(spark, d, "documents")
    i = F.col("doc_id")
    body = F.when(i % 7 == 0, F.col("text")).otherwise(F.concat(F.lit("%PDF-1.7"), "text"))
    kind = F.when(i % 3 == 0, "application/pdf").when(i % 3 == 1, "text/plain; charset=utf-8").otherwise("image/png")
    files = t.select(F.concat(i.cast("string"), F.when(i % 5 == 0, ".txt").otherwise(".PDF")).alias("path"), F.encode(body, "UTF-8").alias("content"), F.octet_length(body).cast("long").alias("length"), kind.alias("content_type"))
    return C.ingest_gate(files, 5000, ("application/pdf", "text/*")).select("path", "length", "reject_reason")


@query(f"WITH {WL} SELECT doc_id, CAST(i AS INTEGER) AS line_no, text FROM (SELECT doc_id, unnest(lines) AS text, unnest(range(len(lines))) AS i FROM wl)")
def wrap_lines(spark, d):
    return L.wrap_lines(table(spark, d, "documents"))


@query(f"WITH {PT} SELECT doc_id, page_no, CAST(count(text) AS BIGINT) AS n_lines, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS n_chars FROM pt GROUP BY 1, 2")
def paginate_text(spark, d):
    return L.page_sizes(table(spark, d, "documents"))


@query(f"WITH {PT} SELECT doc_id, page_no, line_on_page AS block, 0 AS line, 0 AS span, text, 'Helvetica' AS font, CAST(11 AS DOUBLE) AS size, 0 AS flags, CAST(50 AS DOUBLE) AS x0, y - 11 AS y0, 50 + length(text) * 5.5::DOUBLE AS x1, y AS y1 FROM pt WHERE text IS NOT NULL")
def layout_spans(spark, d):
    return L.layout_spans(table(spark, d, "documents"))


@query(f"WITH {SPB} SELECT * FROM sp")
def html_spans(spark, d):
    return L.html_spans(table(spark, d, "pages"), bold=True)


@query("""WITH r AS (SELECT o_custkey AS tab, o_orderkey, o_orderpriority || ' / ' || o_orderstatus || ' / ' || strftime(o_orderdate, '%Y-%m-%d') AS note, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS n FROM orders)
SELECT tab, CAST(CASE WHEN n < 14 THEN 0 ELSE 1 + (n - 14) // 15 END AS INTEGER) AS page_no, CAST(CASE WHEN n < 14 THEN n ELSE (n - 14) % 15 END AS INTEGER) AS row_no, CAST(o_orderkey AS VARCHAR) AS o_orderkey, CASE WHEN length(note) > 20 THEN substring(note, 1, 20) || '...' ELSE note END AS note FROM r""")
def paginate_table(spark, d):
    o = table(spark, d, "orders")
    rows = o.select(F.col("o_custkey").alias("tab"), "o_orderkey", F.concat_ws(" / ", "o_orderpriority", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd")).alias("note"))
    return L.paginate_table(rows, ["tab"], ["o_orderkey"], ["o_orderkey", "note"], 14, 15)


TT = PG + r""", tl AS (SELECT doc_id, page_no, unnest(l) AS line, unnest(range(len(l))) AS "row" FROM (SELECT doc_id, page_no, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM pg)),
tc AS (SELECT doc_id, page_no, CAST("row" AS INTEGER) AS "row", unnest(string_split_regex(trim(line), '\s+')) AS cell, unnest(range(len(string_split_regex(trim(line), '\s+')))) AS col FROM tl)"""


@query(f'WITH {TT} SELECT doc_id, page_no, "row", CAST(col AS INTEGER) AS col, cell FROM tc')
def text_table(spark, d):
    return L.text_table(conversation_pages(spark, d))


@query(f"WITH {PG} SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY page_no) AS text FROM pg GROUP BY 1")
def export_text(spark, d):
    return X.export_text(conversation_pages(spark, d))


@query(f"""WITH {SP}, ln AS (SELECT doc_id, page_no, block, CASE WHEN max(size) > 18 THEN '# ' WHEN max(size) > 16 THEN '## ' WHEN max(size) > 14 THEN '### ' ELSE '' END || trim(string_agg(text, '' ORDER BY span)) || chr(10) AS md FROM sp GROUP BY 1, 2, 3),
p AS (SELECT doc_id, page_no, string_agg(md, '' ORDER BY block) || chr(10) || '---' || chr(10) || chr(10) AS md FROM ln GROUP BY 1, 2) SELECT doc_id, string_agg(md, '' ORDER BY page_no) AS markdown FROM p GROUP BY 1""")
def export_markdown(spark, d):
    return X.export_markdown(L.html_spans(table(spark, d, "pages")))


@query(f"""WITH {PG} SELECT doc_id, page_no, 'Page ' || (page_no + 1) AS title, '<h1>Page ' || (page_no + 1) || '</h1>' || array_to_string(list_transform(list_filter(string_split(text, chr(10) || chr(10)), lambda x: trim(x) <> ''), lambda x: '<p>' || trim(x) || '</p>'), '') AS html FROM pg""")
def export_chapters(spark, d):
    return X.export_chapters(conversation_pages(spark, d))


@query(f"""WITH {TT} SELECT doc_id, page_no, "row", CAST(col AS INTEGER) AS col, cell, 'Table_' || dense_rank() OVER (PARTITION BY doc_id ORDER BY page_no) AS sheet FROM tc
UNION ALL SELECT DISTINCT user_id, 0, 0, 0, 'No tables or text found in PDF', 'Table_1' FROM events WHERE user_id NOT IN (SELECT doc_id FROM tc)""")
def export_tables(spark, d):
    """Users without a conversation count as documents without a table."""
    return X.export_tables(L.text_table(conversation_pages(spark, d)), table(spark, d, "events").select(F.col("user_id").alias("doc_id")))


@query("""SELECT coalesce(a.name, b.name) AS name, floor(a.bytes * 10.0::DOUBLE / 1024 + 0.5) / 10 AS input_kb, floor(b.bytes * 10.0::DOUBLE / 1024 + 0.5) / 10 AS output_kb
FROM (SELECT 'd' || doc_id AS name, strlen(text) AS bytes FROM documents WHERE doc_id % 3 <> 0) a FULL OUTER JOIN (SELECT 'd' || doc_id AS name, strlen(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS bytes FROM documents WHERE doc_id % 4 <> 0) b ON a.name = b.name""".replace("\\\\", "\\"))
def batch_report(spark, d):
    t = table(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name"), "doc_id", "text")
    return C.batch_report(t.where("doc_id % 3 <> 0").select("name", F.octet_length("text").alias("bytes")), t.where("doc_id % 4 <> 0").select("name", F.octet_length(F.trim(F.regexp_replace("text", r"\s+", " "))).alias("bytes")))


@query(r"""SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, t AS text FROM (SELECT doc_id, trim(substring(regexp_replace(regexp_replace('<p>' || text, '<[^<]+?>', '', 'g'), '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g'), 1, 1000)) AS t FROM documents)""")
def run_batch(spark, d):
    from leafmill.operators.text import sanitize_text, strip_html

    registry = {"strip_html": lambda x: x.withColumn("text", strip_html(F.concat(F.lit("<p>"), "text"))), "sanitize": lambda x, limit: x.withColumn("text", sanitize_text(F.col("text"), limit)), "trim": lambda x: x.withColumn("text", F.trim("text"))}
    out, _ = C.run_batch({"documents.parquet": table(spark, d, "documents").select("doc_id", "text")}, [("strip_html", {}), ("sanitize", {"limit": 1000}), ("trim", {})], registry)
    return out["documents_processed"].select("doc_id", F.length("text").cast("long").alias("n_chars"), "text")


@query("""SELECT 'conversations' AS input, 'conversations_converted' AS output, true AS ok, count(*) AS n_rows, NULL AS step FROM conversations UNION ALL SELECT 'documents', 'documents_converted', true, count(*), NULL FROM documents
UNION ALL SELECT 'orders', 'orders_converted', false, NULL, 'run' UNION ALL SELECT 'pages', 'pages_converted', false, NULL, 'words'""")
def run_batch_report(spark, d):
    """Inputs that go through, one that fails at its rows (texts that are no numbers), one that fails when its plan is made (no such column)."""
    inputs = {name: table(spark, d, name) for name in ("conversations", "documents", "pages")}
    inputs["orders"] = table(spark, d, "orders").select(F.col("o_orderpriority").cast("int").alias("text"))
    registry = {"words": lambda x: x.select(F.size(F.split(F.col("text").cast("string"), " ")).alias("n"))}
    return C.run_batch(inputs, [("words", {})], registry)[1].select("input", "output", "ok", "n_rows", "step")


@query(r"""SELECT CAST(count(*) FILTER (doc_id % 3 <> 0) AS BIGINT) AS n_inputs, CAST(count(*) FILTER (doc_id % 4 <> 0) AS BIGINT) AS n_outputs, CAST(coalesce(sum(strlen(text)) FILTER (doc_id % 3 <> 0), 0) AS BIGINT) AS input_bytes,
CAST(coalesce(sum(strlen(trim(regexp_replace(text, '\s+', ' ', 'g')))) FILTER (doc_id % 4 <> 0), 0) AS BIGINT) AS output_bytes FROM documents""".replace("\\\\", "\\"))
def batch_totals(spark, d):
    t = table(spark, d, "documents").select("doc_id", "text")
    return C.batch_totals(t.where("doc_id % 3 <> 0").select(F.octet_length("text").alias("bytes")), t.where("doc_id % 4 <> 0").select(F.octet_length(F.trim(F.regexp_replace("text", r"\s+", " "))).alias("bytes")))


ROMAN_SQL = "CASE WHEN n > 0 THEN repeat('M', n // 1000) || ['', 'C', 'CC', 'CCC', 'CD', 'D', 'DC', 'DCC', 'DCCC', 'CM'][(n % 1000) // 100 + 1] || ['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'][(n % 100) // 10 + 1] || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][n % 10 + 1] ELSE '' END"


@query(f"""SELECT field_id, {ROMAN_SQL} AS roman, chr(CAST(65 + (n - 1 + 26 * 1000) % 26 AS INTEGER)) AS letter, CASE WHEN n % 2 = 0 THEN round(CAST('0x' || hex2 AS INTEGER) / 255.0::DOUBLE, 6) END AS red,
 CASE WHEN length(value) > 8 THEN substring(value, 1, 8) || '...' ELSE value END AS cell, CASE n % 5 WHEN 0 THEN NULL WHEN 1 THEN 's_' || name || '.pdf' WHEN 2 THEN 's_' || name || '.pdf' WHEN 3 THEN 's_' || name || '.x.pdf' ELSE 's_' || name || '.pdf' END AS file, CASE n % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 0.5 ELSE 0 END::DOUBLE AS named_red, CASE WHEN n % 3 <> 0 THEN CAST(n AS DOUBLE) END AS rect_x0, CAST(CASE WHEN n >= 18 THEN 1 WHEN n >= 14 THEN 2 WHEN n >= 12 THEN 3 END AS INTEGER) AS level
FROM (SELECT *, field_id % 1200 AS n, printf('%02x', CAST(field_id % 256 AS INTEGER)) AS hex2 FROM ff)""".replace("SELECT field_id, CASE", f"WITH {FF} SELECT field_id, CASE", 1))
def scalar_functions(spark, d):
    n = (F.col("field_id") % 1200).cast("int")
    f = form_fields(spark, d).withColumn("n", n).withColumn("hex2", F.lower(F.lpad(F.hex(F.col("field_id") % 256), 2, "0")))
    colour = F.when(F.col("n") % 2 == 0, F.concat(F.lit("#"), "hex2", F.lit("00ff"))).otherwise(F.lit("none"))
    rect = F.concat_ws(",", F.col("n").cast("string"), F.lit("0"), F.when(F.col("n") % 3 != 0, F.col("n") + 1).otherwise(F.col("n")).cast("string"), F.lit("5"))
    return f.select("field_id", S.to_roman(F.col("n")).alias("roman"), S.to_letter(F.col("n")).alias("letter"), F.round(S.hex_to_rgb(colour)["r"], 6).alias("red"), S.cell_text(F.col("value"), 8).alias("cell"), S.safe_filename(F.when(F.col("n") % 5 == 0, F.lit("../x.pdf")).otherwise(F.concat(F.lit("in/"), "name", F.element_at(F.array(*map(F.lit, ("", ".txt", ".x.doc", ".PDF"))), (F.col("n") % 5).cast("int")))), F.lit("s")).alias("file"), S.hex_to_rgb(F.element_at(F.array(*map(F.lit, ("green", "Orange", "purple", "nonsense"))), (F.col("n") % 4 + 1).cast("int")), named=True)["r"].alias("named_red"), S.parse_rect(rect)["x0"].alias("rect_x0"), S.heading_level(F.col("n")).alias("level"))
