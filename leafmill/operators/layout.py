"""Layout: from texts, markup and tables to pages, lines and spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.functions.scalars import cell_text
from leafmill.sources.kept import Kept

#: Geometry of a page of text (fixed values).
WIDTH, LINES, MARGIN, STEP, SIZE = 80, 54, 50, 14, 11
PAGE_W, PAGE_H = 595.0, 842.0

#: Tags that part a text (fixed values): those that style what follows, and every closing one.
PARTING = r"(?i)<(/[^>]*|(?:h[1-6]|p|pre|code|li|ul|ol)(?:\s[^>]*)?)>"
#: The same with bold text, which a page's own layout shows in a font of its own.
BOLD_PARTING = PARTING.replace("|ol)", "|ol|b)")
#: What is no text.
UNSEEN = r"(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->"

#: Where a line may be broken: blanks, dashes between words, words up to their end or to a hyphen between letters.
CHUNK = r"(?sU)[\t\n\x0B\f\r ]+|(?<=[\w!\"'&.,?])-{2,}(?=\w)|[^\t\n\x0B\f\r ]+?(?:-(?:(?<=[\w&&[^\d]]{2}-)|(?<=[\w&&[^\d]]-[\w&&[^\d]]-))(?=[\w&&[^\d]]-?[\w&&[^\d]])|(?=[\t\n\x0B\f\r ]|\z)|(?<=[\w!\"'&.,?])(?=-{2,}\w))"


def _filled(state: Column, chunk: Column, width: int) -> Column:
    """A line that takes what fits of a chunk over the width; the rest goes on, line by line, each cut after its last hyphen if it has one."""

    def cut(acc: Column, _: Column) -> Column:
        left = F.lit(width) - F.length(acc["cur"])
        fits = F.substring(acc["rest"], F.lit(1), left)
        hyphen = F.length(F.regexp_extract(fits, r"(?s)^(.*[^-].*-|[^-].*-).", 1)) if width > 1 else F.lit(0)
        end = F.when(hyphen > 0, hyphen).otherwise(left)
        full = F.concat(acc["cur"], F.substring(acc["rest"], F.lit(1), end))
        over = F.struct(F.concat(acc["done"], F.array(full)).alias("done"), F.lit("").alias("cur"), F.substring(acc["rest"], end + 1, F.length(acc["rest"])).alias("rest"))
        last = F.struct(acc["done"].alias("done"), F.concat(acc["cur"], acc["rest"]).alias("cur"), F.lit("").alias("rest"))
        return F.when(F.length(acc["rest"]) > left, over).otherwise(last)

    start = F.struct(state["done"].alias("done"), state["cur"].alias("cur"), chunk.alias("rest"))
    return F.aggregate(F.sequence(F.lit(0), F.length(chunk)), start, cut, lambda acc: F.struct(acc["done"].alias("done"), acc["cur"].alias("cur")))


def _broken(line: Column, width: int) -> Column:
    """Wrap of a line with tabs, runs of blanks, hyphens or words over the width: tabs are expanded to eights, blanks between words stay, those at a break go."""
    tabs = F.split(line, "\t", -1)
    n = F.size(tabs)
    spread = F.aggregate(F.slice(tabs, F.lit(1), n - 1), F.lit(""), lambda a, x: F.concat(a, x, F.repeat(F.lit(" "), F.lit(8) - F.pmod(F.length(a) + F.length(x), F.lit(8)))), lambda a: F.concat(a, F.element_at(tabs, -1)))
    chunks = F.regexp_extract_all(F.translate(spread, "\x0b\x0c\r", "   "), F.lit(CHUNK), F.lit(0))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def ended(acc: Column) -> Column:
        cur = F.rtrim(acc["cur"])
        return F.when(cur == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(cur)))

    def step(acc: Column, c: Column) -> Column:
        blank = F.trim(c) == ""
        fits = F.length(acc["cur"]) + F.length(c) <= width
        new = F.when(blank, F.lit("")).otherwise(c)
        return (
            F.when(blank & (acc["cur"] == "") & (F.size(acc["done"]) > 0), acc)
            .when(fits, F.struct(acc["done"].alias("done"), F.concat(acc["cur"], c).alias("cur")))
            .when(~blank & (F.length(c) > width), _filled(acc, c, width))
            .otherwise(F.struct(ended(acc).alias("done"), new.alias("cur")))
        )

    return F.aggregate(chunks, start, step, ended)


def wrap_line(line: Column, width: int = WIDTH) -> Column:
    """Greedy word wrap of one line to an array of lines, by the rules of Python's textwrap; a blank line gives none."""
    words = F.filter(F.split(line, " "), lambda w: w != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def step(acc: Column, w: Column) -> Column:
        fits = F.length(acc["cur"]) + 1 + F.length(w) <= width
        return F.when(acc["cur"] == "", F.struct(acc["done"].alias("done"), w.alias("cur"))).when(fits, F.struct(acc["done"].alias("done"), F.concat(acc["cur"], F.lit(" "), w).alias("cur"))).otherwise(F.struct(F.concat(acc["done"], F.array(acc["cur"])).alias("done"), w.alias("cur")))

    plain = F.aggregate(words, start, step, lambda acc: F.when(acc["cur"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["cur"]))))
    odd = F.rlike(line, F.lit(rf"[-\t\x0B\f\r]|  |^ |[^ ]{{{width + 1}}}"))
    return F.when(odd, _broken(line, width)).otherwise(plain)


def wrapped(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id and lines (array) of each text; no shuffle."""
    return docs.select("doc_id", F.flatten(F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: wrap_line(x, width))).alias("lines"))


def wrap_lines(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, line_no, text: the wrapped lines of each text in order."""
    return wrapped(docs, width).select("doc_id", F.posexplode("lines").alias("line_no", "text"))


def paginate_text(docs: DataFrame, lines_per_page: int = LINES) -> DataFrame:
    """doc_id, page_no, line_on_page, y, text; a text without lines gives one empty page (null line)."""
    i = F.col("i")
    return wrapped(docs).select("doc_id", F.posexplode_outer("lines").alias("i", "text")).select("doc_id", F.coalesce(F.floor(i / lines_per_page), F.lit(0)).cast("int").alias("page_no"), F.pmod(i, F.lit(lines_per_page)).alias("line_on_page"), (MARGIN + STEP * F.pmod(i, F.lit(lines_per_page))).cast("double").alias("y"), "text")


def page_sizes(docs: DataFrame) -> DataFrame:
    """Lines and characters of each page."""
    return paginate_text(docs).groupBy("doc_id", "page_no").agg(F.count("text").alias("n_lines"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n_chars"))


def _boxed(df: DataFrame, line: Column, size: Column) -> DataFrame:
    y = (MARGIN + STEP * line).cast("double")
    return df.withColumn("x0", F.lit(float(MARGIN))).withColumn("y0", y - size).withColumn("x1", MARGIN + F.length("text") * size * 0.5).withColumn("y1", y)


def layout_spans(docs: DataFrame) -> DataFrame:
    """A span for each wrapped line: place, font and box."""
    lines = paginate_text(docs).where("text is not null").select("doc_id", "page_no", F.col("line_on_page").alias("block"), F.lit(0).alias("line"), F.lit(0).alias("span"), "text", F.lit("Helvetica").alias("font"), F.lit(float(SIZE)).alias("size"), F.lit(0).alias("flags"))
    return _boxed(lines, F.col("block"), F.col("size"))


def unescape(text: Column) -> Column:
    for mark, char in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = F.replace(text, F.lit(mark), F.lit(char))
    return text


def scan_html(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", bold: bool = False) -> DataFrame:
    """doc_id, i, tag, text: the pieces of markup that are not blank, in order, with the tag they stand under.

    A piece is what stands between two of the tags that part a text. Its tag is the one
    before it; after a closing tag, a list's start, or nothing, it is p. Other tags are no
    text (a br is a space); scripts, styles and comments are left out, &lt; &gt; &amp;
    resolved.

    bold: a b parts texts too, and is the tag of what follows.
    """
    parting = BOLD_PARTING if bold else PARTING
    html = F.regexp_replace(F.coalesce(F.col(html_col), F.lit("")), UNSEEN, "")
    tags = F.transform(F.regexp_extract_all(html, F.lit(parting), F.lit(1)), lambda t: F.lower(F.regexp_extract(t, "^[A-Za-z0-9]*", 0)))
    tags = F.concat(F.array(F.lit("p")), F.transform(tags, lambda t: F.when(t.isin("", "ul", "ol"), F.lit("p")).otherwise(t)))
    seen = lambda x: F.trim(unescape(F.regexp_replace(F.regexp_replace(x, r"(?i)<br\s*/?>", " "), "<[^>]*>", "")))
    pieces = F.zip_with(tags, F.split(html, parting, -1), lambda t, x: F.struct(t.alias("tag"), seen(x).alias("text")))
    return pages.select(F.col(id_col).alias("doc_id"), F.posexplode(F.filter(pieces, lambda x: x["text"] != "")).alias("i", "z")).select("doc_id", "i", "z.tag", "z.text")


def scan_markdown(docs: DataFrame) -> DataFrame:
    """doc_id, i, tag, text: lines of markdown by their prefix; fences toggle code; blank lines vanish."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("i", "raw"))
    fence = F.startswith(F.ltrim("raw"), F.lit("```"))
    lines = lines.withColumn("fences", F.sum(fence.cast("int")).over(W.partitionBy("doc_id").orderBy("i"))).where(~fence & (F.trim("raw") != ""))
    hashes = F.length(F.regexp_extract("raw", r"^(#{1,6}) ", 1))
    item = F.regexp_extract("raw", r"^\s*(?:[-*+]|\d+\.) (.*)$", 1)
    tag = F.when(F.col("fences") % 2 == 1, F.lit("code")).when(hashes > 0, F.concat(F.lit("h"), hashes.cast("string"))).when(item != "", F.lit("li")).otherwise(F.lit("p"))
    lines = lines.withColumn("tag", tag)
    text = F.when(F.col("tag") == "code", F.col("raw")).when(F.col("tag") == "li", item).otherwise(F.regexp_replace("raw", "^#{1,6} ", ""))
    return lines.select("doc_id", "i", "tag", F.trim(text).alias("text"))


def styled_spans(pieces: DataFrame, lines_per_page: int = LINES) -> DataFrame:
    """Spans of tagged pieces: font, size and flags by tag, a line each."""
    tag = F.col("tag")
    strong, mono = tag.isin("h1", "h2", "h3", "h4", "h5", "h6", "b"), tag.isin("code", "pre")
    size = F.when(tag == "h1", 18.0).when(tag == "h2", 14.0).when(tag == "h3", 12.0).when(mono, 9.0).otherwise(11.0)
    font = F.when(mono, F.lit("Courier")).when(strong, F.lit("Helvetica-Bold")).otherwise(F.lit("Helvetica"))
    flags = F.when(mono, 8).when(strong, 16).otherwise(0)
    out = pieces.where("text <> ''").select("doc_id", F.floor(F.col("i") / lines_per_page).cast("int").alias("page_no"), F.pmod("i", F.lit(lines_per_page)).alias("block"), F.lit(0).alias("line"), F.lit(0).alias("span"), "text", font.alias("font"), size.alias("size"), flags.alias("flags"))
    return _boxed(out, F.col("block"), F.col("size"))


def html_spans(pages: DataFrame, bold: bool = False) -> DataFrame:
    """Spans of pages of markup; bold: bold text has spans of its own."""
    return styled_spans(scan_html(pages, bold=bold))


def numbered_rows(rows: DataFrame, table: list[str], order: list[str], name: str) -> DataFrame:
    """rows with their number in their table, from 0, as a column: a table may have any number of rows.

    Rows are sorted by range over all tasks and numbered within the parts that come of it;
    what the parts before hold of a table is a sum over a row for each part.
    """
    kept = Kept(rows.sparkSession, "numbers")
    parts = kept.keep(rows.repartitionByRange(*table, *order).withColumn("__part", F.spark_partition_id()))
    here = parts.withColumn("__k", F.row_number().over(W.partitionBy("__part", *table).orderBy(*order)) - 1)
    sums = parts.groupBy("__part", *table).agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy(*table).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select(F.col("__part").alias("__p"), *[F.col(c).alias(f"__{c}") for c in table], before.alias("__start"))
    same = [F.col("__part") == F.col("__p"), *[F.col(c).eqNullSafe(F.col(f"__{c}")) for c in table]]
    return here.join(starts, same).select(*rows.columns, (F.col("__start") + F.col("__k")).alias(name))


def paginate_table(rows: DataFrame, table: list[str], order: list[str], cells: list[str], first: int = 28, later: int = 28) -> DataFrame:
    """Page and row on the page of each table row; cell texts over 20 characters are cut.

    table: columns that name a table; order: a total order of its rows. One table may hold
    most of all rows.
    """
    page = F.when(F.col("__row") < first, F.lit(0)).otherwise(1 + F.floor((F.col("__row") - first) / later)).cast("int")
    on_page = F.when(F.col("__row") < first, F.col("__row")).otherwise(F.pmod(F.col("__row") - first, F.lit(later)))
    return numbered_rows(rows, table, order, "__row").select(*table, page.alias("page_no"), on_page.cast("int").alias("row_no"), *[cell_text(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in cells])


def text_table(pages: DataFrame, strict_reference: bool = False) -> DataFrame:
    """Ragged table of a page's text: cells by white space; rows and columns without any text are dropped.

    strict_reference: only missing cells count as empty, as an empty string is a value there.
    """
    lines = pages.select("doc_id", "page_no", F.posexplode(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x) != "")).alias("row", "line"))
    cells = lines.select("doc_id", "page_no", "row", F.posexplode(F.split(F.trim("line"), r"\s+")).alias("col", "cell"))
    cells = cells.withColumn("cell", F.coalesce(F.trim("cell"), F.lit("")))
    if strict_reference:
        return cells
    key = ["doc_id", "page_no"]
    full = F.max((F.col("cell") != "").cast("int"))
    judged = cells.withColumn("__r", full.over(W.partitionBy(*key, "row"))).withColumn("__c", full.over(W.partitionBy(*key, "col")))
    return judged.where("__r = 1 and __c = 1").drop("__r", "__c")
