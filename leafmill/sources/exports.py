"""Sinks: texts, markdown, chapters and table sheets as rows, and their writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.functions.scalars import markdown_mark
from leafmill.operators.text import ordered


def export_text(pages: DataFrame) -> DataFrame:
    """Page texts of each document, joined by blank lines."""
    return pages.groupBy("doc_id").agg(ordered("text", ["page_no"], "\n\n").alias("text"))


def export_markdown(spans: DataFrame) -> DataFrame:
    """A line for each line with text, marked by its largest size; each page ends with a rule. Spans are shuffled once, by document."""
    lines = spans.repartition("doc_id").groupBy("doc_id", "page_no", "block", "line").agg(F.max("size").alias("s"), F.trim(ordered("text", ["span"])).alias("t")).where("t <> ''")
    lines = lines.withColumn("md", F.concat(markdown_mark(F.col("s")), F.col("t"), F.lit("\n")))
    pages = lines.groupBy("doc_id", "page_no").agg(F.concat(ordered("md", ["block", "line"]), F.lit("\n---\n\n")).alias("md"))
    return pages.groupBy("doc_id").agg(ordered("md", ["page_no"]).alias("markdown"))


def export_chapters(pages: DataFrame) -> DataFrame:
    """A chapter for each page: a heading and a paragraph for each part between blank lines."""
    parts = F.filter(F.split(F.coalesce("text", F.lit("")), "\n\n"), lambda x: F.trim(x) != "")
    body = F.array_join(F.transform(parts, lambda x: F.concat(F.lit("<p>"), F.trim(x), F.lit("</p>"))), "")
    title = F.concat(F.lit("Page "), (F.col("page_no") + 1).cast("string"))
    return pages.select("doc_id", "page_no", title.alias("title"), F.concat(F.lit("<h1>"), title, F.lit("</h1>"), body).alias("html"))


#: What stands in the sheet of a document without tables and text (fixed value).
NO_TABLE = "No tables or text found in PDF"


def export_tables(cells: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Cells with the name of their sheet: Table_<n> by page of the document, 31 characters at most.

    documents (doc_id): those of them without a cell get one sheet of one cell that says so.
    """
    n = F.dense_rank().over(W.partitionBy("doc_id").orderBy("page_no"))
    out = cells.withColumn("sheet", F.substring(F.concat(F.lit("Table_"), n.cast("string")), 1, 31))
    if documents is None:
        return out
    bare = documents.select("doc_id").distinct().join(cells.select("doc_id").distinct(), "doc_id", "left_anti")
    zero = F.lit(0)
    return out.unionByName(bare.select("doc_id", zero.alias("page_no"), zero.alias("row"), zero.alias("col"), F.lit(NO_TABLE).alias("cell"), F.lit("Table_1").alias("sheet")))


def write_texts(docs: DataFrame, path: str) -> None:
    """Texts as lines of JSON with their ids, in one file for each task: a folder or a file for each document would be too many."""
    docs.select(F.to_json(F.struct("doc_id", "text")).alias("value")).write.text(path)


def write_sheets(cells: DataFrame, path: str) -> None:
    """Cells in a folder for each number of sheet: as many as the document with most tables has."""
    cells.write.partitionBy("sheet").parquet(path)
