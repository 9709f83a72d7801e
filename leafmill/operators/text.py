"""Text operators over pages (doc_id, page_no, text) and spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.functions.arrays import let, running
from leafmill.functions.scalars import decode_flags, heading_level
from leafmill.operators.grid import boxes_at_points, overlapping
from leafmill.operators.search import search_context  # noqa: F401  beside search_text

SPAN_KEY = ("doc_id", "page_no", "block", "line", "span")
# Fonts that every reader has, and what stands for others, in the order they are tried.
BUILT_IN = ("Times-Roman", "Times-Bold", "Times-Italic", "Times-BoldItalic", "Helvetica", "Helvetica-Bold", "Helvetica-Oblique", "Helvetica-BoldOblique", "Courier", "Courier-Bold", "Courier-Oblique", "Courier-BoldOblique", "Symbol", "ZapfDingbats")
SUBSTITUTES = (("times", "Times-Roman"), ("timesnewroman", "Times-Roman"), ("arial", "Helvetica"), ("helvetica", "Helvetica"), ("courier", "Courier"), ("couriernew", "Courier"), ("verdana", "Helvetica"), ("georgia", "Times-Roman"), ("palatino", "Times-Roman"), ("bookman", "Times-Roman"))


def ordered(value: str, order: list[str], sep: str = "") -> Column:
    """Texts of a group joined in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("__v")))), lambda x: x["__v"]), sep)


def extract_text(spans: DataFrame, max_pages: int | None = None) -> DataFrame:
    """Text of each document: a space after each span, a line feed after each block. Spans are shuffled once, by document."""
    if max_pages is not None:
        spans = spans.where(F.col("page_no") < max_pages)
    blocks = spans.repartition("doc_id").groupBy("doc_id", "page_no", "block").agg(F.concat(ordered("text", ["line", "span"], " "), F.lit(" \n")).alias("t"))
    return blocks.groupBy("doc_id").agg(ordered("t", ["page_no", "block"]).alias("text"))


def text_properties(spans: DataFrame, italic_bit: int = 64) -> DataFrame:
    """Spans with decoded flags; missing fonts and sizes are Helvetica and 12."""
    return spans.select(*SPAN_KEY, F.coalesce("text", F.lit("")).alias("text"), F.coalesce("font", F.lit("Helvetica")).alias("font"), F.coalesce("size", F.lit(12.0)).alias("size"), *decode_flags(F.coalesce("flags", F.lit(0)), italic_bit))


def nested_layout(spans: DataFrame) -> DataFrame:
    """blocks of each page as nested arrays: block, lines, spans."""
    lines = spans.groupBy("doc_id", "page_no", "block", "line").agg(F.array_sort(F.collect_list(F.struct("span", "text", "font", "size", "flags"))).alias("spans"))
    blocks = lines.groupBy("doc_id", "page_no", "block").agg(F.array_sort(F.collect_list(F.struct("line", "spans"))).alias("lines"))
    return blocks.groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_list(F.struct("block", "lines"))).alias("blocks"))


def places(text: Column, query: Column) -> Column:
    """Starts (from 0) of a literal in a text, overlaps included. Only texts that hold it pay for the cuts.

    The text is cut before every hit, so that all parts but the first begin with one.
    """
    before_hit = F.concat(F.lit("(?="), F.lit(r"\Q"), query, F.lit(r"\E"), F.lit(")"))
    sizes = F.transform(F.split(text, before_hit, -1), lambda x: F.length(x))

    def starts(n: Column) -> Column:
        ends = running(F.slice(n, F.lit(1), F.size(n) - 1), lambda x, y: x + y)
        return F.when(text.startswith(query), F.concat(F.array(F.lit(0)), ends)).otherwise(ends)

    return F.when(text.contains(query), let(sizes, starts)).otherwise(F.array().cast("array<int>"))


def _query(query: str) -> str:
    if not query or not query.strip():
        raise ValueError("empty search text")
    return query.strip()


def search_text(spans: DataFrame, query: str, ignore_case: bool = False) -> DataFrame:
    """Hits of a literal in spans: index on the page, and the hit's box and corners from the span's width rule."""
    q = _query(query)
    fold = F.lower if ignore_case else (lambda x: x)
    hit = spans.where(fold(F.col("text")).contains(fold(F.lit(q))))
    hit = hit.select("doc_id", "page_no", "block", "line", "span", "size", "x0", "y0", "y1", F.posexplode(places(fold(F.col("text")), fold(F.lit(q)))).alias("k", "at"))
    left = F.col("x0") + F.col("at") * F.col("size") * 0.5
    right = left + len(q) * F.col("size") * 0.5
    index = F.row_number().over(W.partitionBy("doc_id", "page_no").orderBy("block", "line", "span", "at")) - 1
    out = hit.select("doc_id", "page_no", index.alias("idx"), left.alias("hx0"), F.col("y0").alias("hy0"), right.alias("hx1"), F.col("y1").alias("hy1"))
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return out.withColumn("corners", F.array(corner("hx0", "hy0"), corner("hx1", "hy0"), corner("hx0", "hy1"), corner("hx1", "hy1")))


def replace_text(spans: DataFrame, search: str, new: str) -> tuple[DataFrame, DataFrame]:
    """Spans with every hit replaced, font kept; and hits per page (0 where there are none). replaced_areas() has where they were."""
    if not search:
        raise ValueError("empty search text")
    hits = ((F.length("text") - F.length(F.replace("text", F.lit(search), F.lit("")))) / len(search)).cast("long")
    out = spans.withColumn("n_hits", hits).withColumn("text", F.replace("text", F.lit(search), F.lit(new))).withColumn("x1", F.col("x0") + F.length("text") * F.col("size") * 0.5)
    return out.drop("n_hits"), out.groupBy("doc_id", "page_no").agg(F.sum("n_hits").alias("n_hits"))


def replaced_areas(spans: DataFrame, search: str) -> DataFrame:
    """Where replace_text() replaces: doc_id, page_no, idx (of the hit on its page), hx0, hy0, hx1, hy1, and the font and size of what is put there.

    The hits are those that don't overlap, from the left. The font is that of the first span
    whose box holds the middle of the hit, Helvetica and 12 where none does.
    """
    if not search:
        raise ValueError("empty search text")
    parts = F.split("text", F.concat(F.lit(r"\Q"), F.lit(search), F.lit(r"\E")), -1)
    hit = spans.where(F.col("text").contains(search)).select(*SPAN_KEY, "size", "x0", "y0", "y1", F.posexplode(running(F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda x: F.length(x)), lambda x, y: x + y)).alias("k", "before"))
    left = F.col("x0") + (F.col("before") + F.col("k") * len(search)) * F.col("size") * 0.5
    hit = hit.withColumns({"hx0": left, "hx1": left + len(search) * F.col("size") * 0.5}).withColumnsRenamed({"y0": "hy0", "y1": "hy1"})
    index = F.row_number().over(W.partitionBy("doc_id", "page_no").orderBy("block", "line", "span", "k")) - 1
    hit = hit.select("doc_id", "page_no", index.alias("idx"), "hx0", "hy0", "hx1", "hy1")
    middle = hit.select(F.struct("doc_id", "page_no", "idx").alias("point_id"), "doc_id", "page_no", ((F.col("hx0") + F.col("hx1")) / 2).alias("x"), ((F.col("hy0") + F.col("hy1")) / 2).alias("y"))
    found = font_at_points(spans, middle).select("point_id.*", "font", "size")
    return hit.join(found, ["doc_id", "page_no", "idx"], "left").withColumns({"font": F.coalesce("font", F.lit("Helvetica")), "size": F.coalesce("size", F.lit(12.0))})


def font_usage(spans: DataFrame) -> DataFrame:
    """Characters by font and size on each page, with style, first span's flags and share of the page (2 decimals)."""
    first = F.min_by("flags", F.struct("block", "line", "span"))
    g = spans.groupBy("doc_id", "page_no", "font", "size").agg(F.sum(F.length("text")).alias("char_count"), first.alias("flags"))
    total = F.sum("char_count").over(W.partitionBy("doc_id", "page_no"))
    share = F.when(total > 0, F.floor(F.col("char_count") * 10000.0 / total + 0.5) / 100).otherwise(0.0)
    bold, italic, *_ = decode_flags(F.col("flags"))
    return g.select("doc_id", "page_no", "font", "size", "char_count", bold, italic, total.alias("page_chars"), share.cast("double").alias("percentage"))


def document_fonts(spans: DataFrame) -> DataFrame:
    return spans.groupBy("doc_id", "font").agg(F.sort_array(F.collect_set("page_no")).alias("pages"))


def match_font(names: DataFrame, font: str = "font") -> DataFrame:
    """match: the built-in font for each font name: the first whose name it holds, then the first substitute, then by style."""
    norm = lambda c: F.lower(F.replace(F.replace(c, F.lit("-"), F.lit("")), F.lit(" "), F.lit("")))
    name = norm(F.coalesce(F.col(font), F.lit("")))
    table = [(b.lower().replace("-", ""), b) for b in BUILT_IN] + list(SUBSTITUTES)
    found = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in table]), lambda x: name.contains(x["k"]))
    bold, italic = name.contains("bold"), name.contains("italic")
    style = F.when(bold & italic, F.lit("Helvetica-BoldOblique")).when(bold, F.lit("Helvetica-Bold")).when(italic | name.contains("oblique"), F.lit("Helvetica-Oblique")).when(name.contains("mono"), F.lit("Courier")).when(name.contains("serif"), F.lit("Times-Roman")).otherwise(F.lit("Helvetica"))
    return names.withColumn("match", F.coalesce(F.get(found, F.lit(0))["v"], style))


def font_at_points(spans: DataFrame, points: DataFrame) -> DataFrame:
    """First span (in order) whose box holds each point (point_id, doc_id, page_no, x, y), edges included; null fonts where none does.

    Points meet spans by cells of grids, so a crowded page costs what lies at its points.
    """
    hit = boxes_at_points(spans, points, ["block", "line", "span", "font", "size"])
    best = hit.groupBy("point_id").agg(F.min_by(F.struct("font", "size"), F.struct("block", "line", "span")).alias("b"))
    return points.join(best, "point_id", "left").select("point_id", "doc_id", "page_no", "b.font", "b.size")


def auto_toc(spans: DataFrame, thresholds: tuple[float, float, float] = (18, 14, 12), existing: DataFrame | None = None) -> DataFrame:
    """Bookmarks from the sizes of lines' first spans, after the existing ones: idx, level, title (50 characters), page from 1."""
    if len(thresholds) != 3:
        raise ValueError("three thresholds are needed")
    lines = spans.groupBy("doc_id", "page_no", "block", "line").agg(F.min_by("size", "span").alias("size"), F.trim(ordered("text", ["span"])).alias("t")).where("t <> ''")
    heads = lines.withColumn("level", heading_level(F.col("size"), thresholds)).where("level is not null")
    found = heads.select("doc_id", F.struct(F.lit(1).alias("new"), "page_no", "block", "line").alias("o"), "level", F.substring("t", 1, 50).alias("title"), (F.col("page_no") + 1).alias("page"))
    if existing is not None:
        found = existing.select("doc_id", F.struct(F.lit(0).alias("new"), F.col("idx").alias("page_no"), F.lit(0).cast(found.schema["o"].dataType["block"].dataType).alias("block"), F.lit(0).alias("line")).alias("o"), "level", "title", "page").unionByName(found)
    return found.select("doc_id", (F.row_number().over(W.partitionBy("doc_id").orderBy("o")) - 1).alias("idx"), "level", "title", "page")


def redact_regions(spans: DataFrame, regions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Spans outside all regions (doc_id, page_no, rx0, ry0, rx1, ry1), and the ones taken out. Spans without a full box are outside."""
    key = [*SPAN_KEY, "x0", "y0", "x1", "y1"]
    gone = overlapping(spans, regions, key).select(*[F.col(c).alias(f"__{c}") for c in key])
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in key]
    return spans.join(gone, same, "left_anti"), spans.join(gone, same, "left_semi")


def strip_html(text: Column) -> Column:
    return F.regexp_replace(text, "<[^<]+?>", "")


def sanitize_text(text: Column, limit: int = 1000) -> Column:
    """Without control characters other than tab and line ends, and cut to a length."""
    return F.substring(F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""), 1, limit)
