"""Bookmarks and links. toc: doc_id, idx, level, title, page (from 1); links: doc_id, page_no, idx, ..."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.operators.pages import errors, page_counts

HREF = r"(?i)<a\s(?:[^>]*\s)?href\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)"


def toc_entries(toc: DataFrame) -> DataFrame:
    """Bookmarks with what they point to: a uri if they have one, else a page."""
    kind = F.when(F.col("uri").isNotNull(), F.lit("uri")).when(F.col("page") > 0, F.lit("page")).otherwise(F.lit("none")) if "uri" in toc.columns else F.when(F.col("page") > 0, F.lit("page")).otherwise(F.lit("none"))
    return toc.select("doc_id", "idx", "level", "title", "page", kind.alias("link_type"))


def set_toc(entries: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New bookmarks of each document; those whose page is not in it are dropped and reported. Defaults: level 1, no title, page 1."""
    e = entries.select("doc_id", "idx", F.coalesce("level", F.lit(1)).alias("level"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("page", F.lit(1)).alias("page")).join(page_counts(pages), "doc_id")
    good = F.col("page").between(1, F.col("n_pages"))
    bad = e.where(~good)
    kept = e.where(good).withColumn("idx", F.row_number().over(W.partitionBy("doc_id").orderBy("idx")) - 1).drop("n_pages")
    return kept, errors(bad, "set_toc", F.col("idx"), F.concat(F.lit("Item "), F.col("idx").cast("string"), F.lit(": Invalid page number "), F.col("page").cast("string")))


def edit_bookmarks(toc: DataFrame, edits: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """edits: doc_id, seq, kind (add, update, delete), idx, level, title, page. Updates keep what is null; indices are those before the edits."""
    n = page_counts(pages)
    size = toc.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_toc"))
    e = edits.join(n, "doc_id", "left").join(size, "doc_id", "left")
    page_bad = F.col("page").isNotNull() & ~F.coalesce(F.col("page").between(1, F.col("n_pages")), F.lit(False))
    why = F.when((F.col("kind") == "add") & (F.coalesce(F.trim("title"), F.lit("")) == ""), F.lit("title is required")).when((F.col("kind") == "add") & F.col("page").isNull(), F.lit("page is required")).when(page_bad, F.lit("invalid page")).when((F.col("kind") != "add") & ~F.coalesce(F.col("idx").between(0, F.coalesce("n_toc", F.lit(0)) - 1), F.lit(False)), F.lit("invalid index"))
    e = e.withColumn("__why", why)
    ok = e.where("__why is null")
    new = F.max_by(F.struct("level", "title", "page"), "seq")
    up = ok.where("kind = 'update'").groupBy("doc_id", "idx").agg(new.alias("u"))
    gone = ok.where("kind = 'delete'").select("doc_id", "idx").distinct()
    old = toc.join(gone, ["doc_id", "idx"], "left_anti").join(up, ["doc_id", "idx"], "left")
    old = old.select("doc_id", F.struct(F.lit(0).alias("new"), F.col("idx").cast("long").alias("k")).alias("o"), *[F.coalesce(f"u.{c}", c).alias(c) for c in ("level", "title", "page")])
    add = ok.where("kind = 'add'").select("doc_id", F.struct(F.lit(1).alias("new"), F.col("seq").cast("long").alias("k")).alias("o"), F.coalesce("level", F.lit(1)).alias("level"), "title", "page")
    out = old.unionByName(add).withColumn("idx", F.row_number().over(W.partitionBy("doc_id").orderBy("o")) - 1)
    return out.select("doc_id", "idx", "level", "title", "page"), errors(e.where("__why is not null"), "edit_bookmarks", F.col("seq"), F.col("__why"))


def bookmarks_by_page(toc: DataFrame, pages: DataFrame, page: int) -> DataFrame:
    """Bookmarks whose target is a page (from 0) that the document has."""
    has = pages.where(F.col("page_no") == page).select("doc_id").distinct()
    return toc.where(F.col("page") == page + 1).join(has, "doc_id", "left_semi")


def link_type() -> Column:
    """Type of a link (uri, dest_page, named_dest, file_path) by the first key present."""
    return F.when(F.col("uri").isNotNull(), F.lit("uri")).when(F.col("dest_page").isNotNull(), F.lit("internal")).when(F.col("named_dest").isNotNull(), F.lit("named")).when(F.col("file_path").isNotNull(), F.lit("file")).otherwise(F.lit("unknown"))


def page_links(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Links of each page of markup, in order: external ones are uris, #name ones named, file: ones files, others internal."""
    out = pages.select(F.col(id_col).alias("doc_id"), F.posexplode(F.transform(F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(HREF), F.lit(1)), lambda x: F.regexp_replace(x, "^[\"']|[\"']$", ""))).alias("idx", "target"))
    t = F.col("target")
    kind = F.when(t.rlike("^(https?:|mailto:)"), F.lit("uri")).when(t.startswith("#"), F.lit("named")).when(t.startswith("file:"), F.lit("file")).when(t != "", F.lit("internal")).otherwise(F.lit("unknown"))
    return out.withColumn("type", kind)


def edit_links(links: DataFrame, add: DataFrame, remove: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """add: doc_id, page_no, seq, uri, dest_page (from 1), x, y, w, h; a uri wins over a page. remove: doc_id, page_no, idx.

    Returns the links with new indices and what could not be done. Removal is by the index
    before the edits.
    """
    a = add.join(page_counts(pages), "doc_id", "left")
    why = F.when(F.col("uri").isNull() & F.col("dest_page").isNull(), F.lit("a uri or a page is needed")).when(F.col("uri").isNull() & ~F.coalesce(F.col("dest_page").between(1, F.col("n_pages")), F.lit(False)), F.lit("page out of range"))
    a = a.withColumn("__why", why)
    gone = remove.select("doc_id", "page_no", "idx").distinct()
    lost = gone.join(links, ["doc_id", "page_no", "idx"], "left_anti")
    rect = lambda x0, y0, x1, y1: [x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), x1.cast("double").alias("x1"), y1.cast("double").alias("y1")]
    old = links.join(gone, ["doc_id", "page_no", "idx"], "left_anti").select("doc_id", "page_no", F.struct(F.lit(0).alias("new"), F.col("idx").cast("long").alias("k")).alias("o"), "type", "uri", "dest_page", "x0", "y0", "x1", "y1")
    new = a.where("__why is null").select("doc_id", "page_no", F.struct(F.lit(1).alias("new"), F.col("seq").cast("long").alias("k")).alias("o"), F.when(F.col("uri").isNotNull(), F.lit("uri")).otherwise(F.lit("internal")).alias("type"), "uri", F.when(F.col("uri").isNull(), F.col("dest_page") - 1).alias("dest_page"), *rect(F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h")))
    out = old.unionByName(new).withColumn("idx", F.row_number().over(W.partitionBy("doc_id", "page_no").orderBy("o")) - 1).drop("o")
    bad = errors(a.where("__why is not null"), "edit_links", F.col("seq"), F.col("__why")).unionByName(errors(lost, "edit_links", F.col("idx"), F.lit("invalid index")))
    return out, bad


def links_left(links: DataFrame, removed: DataFrame) -> DataFrame:
    """How many links remain (n_left) on each page of removed (doc_id, page_no, idx) after these are gone; indices that name none take none away."""
    gone = removed.select("doc_id", "page_no", "idx").distinct()
    left = links.join(gone, ["doc_id", "page_no", "idx"], "left_anti").groupBy("doc_id", "page_no").agg(F.count(F.lit(1)).alias("n"))
    return gone.select("doc_id", "page_no").distinct().join(left, ["doc_id", "page_no"], "left").select("doc_id", "page_no", F.coalesce("n", F.lit(0)).alias("n_left"))


def broken_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Internal links (dest_page from 0) to pages that their document lacks."""
    there = pages.select("doc_id", F.col("page_no").alias("dest_page"))
    return links.where("type = 'internal'").join(there, ["doc_id", "dest_page"], "left_anti")
