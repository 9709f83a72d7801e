"""Page-set operators. A document is its page rows (doc_id, page_no from 0, ...); an edit is relational work and renumbering.

Argument errors raise when the plan is built. Rows that can't be edited come as a second
DataFrame of errors: op, doc_id, item, message.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.functions.scalars import number_label
from leafmill.operators.folds import fold_by_key

#: Page sizes by name (fixed values).
SIZES = {"A4": (595.0, 842.0), "Letter": (612.0, 792.0), "Legal": (612.0, 1008.0), "A3": (842.0, 1191.0), "A5": (420.0, 595.0), "Tabloid": (792.0, 1224.0)}


def renumber(df: DataFrame, order: list[Column | str], keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """New page_no from 0 by an order inside each document."""
    return df.withColumn("page_no", F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1)


def page_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages"))


def errors(df: DataFrame, op: str, item: Column, message: Column) -> DataFrame:
    return df.select(F.lit(op).alias("op"), "doc_id", item.cast("string").alias("item"), message.alias("message"))


def merge_documents(pages: DataFrame, order: DataFrame) -> tuple[DataFrame, DataFrame]:
    """order: out_id, doc_id, pos. Pages of each output in the given order; outputs with a missing input fail whole."""
    counts = page_counts(pages)
    plan = order.join(counts, "doc_id", "left")
    gone = plan.where("n_pages is null")
    offsets = plan.join(gone.select("out_id").distinct(), "out_id", "left_anti").withColumn("__at", F.coalesce(F.sum("n_pages").over(W.partitionBy("out_id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    merged = pages.join(offsets.select("out_id", "doc_id", "pos", "__at"), "doc_id").withColumn("source_page", F.col("page_no")).withColumn("page_no", (F.col("page_no") + F.col("__at")).cast("int")).drop("__at", "pos").withColumnRenamed("doc_id", "source_doc").withColumnRenamed("out_id", "doc_id")
    return merged, errors(gone, "merge_documents", F.col("out_id"), F.lit("unreadable input"))


def parse_ranges(text: str) -> list[tuple[int, int]]:
    """[(first, last)] of '1-3,5'."""
    out = []
    for part in text.split(","):
        a, _, b = part.strip().partition("-")
        out.append((int(a), int(b or a)))
    return out


def split_ranges(pages: DataFrame, ranges: str) -> DataFrame:
    """doc_id, part, page_no: the pages of each range (from 1, inclusive); ranges outside a document are skipped."""
    table = F.explode(F.array(*[F.struct(F.lit(i).alias("part"), F.lit(a - 1).alias("lo"), F.lit(b - 1).alias("hi")) for i, (a, b) in enumerate(parse_ranges(ranges))]))
    cut = pages.join(page_counts(pages), "doc_id").withColumn("r", table).where("page_no between r.lo and r.hi and r.lo >= 0 and r.hi < n_pages")
    return cut.withColumn("part", F.col("r.part")).withColumn("page_no", F.col("page_no") - F.col("r.lo")).drop("r", "n_pages")


def _beyond(pages: DataFrame, wanted: list[int], op: str) -> DataFrame:
    bad = page_counts(pages).withColumn("p", F.explode(F.array(*map(F.lit, wanted)))).where("p < 0 or p >= n_pages")
    return errors(bad, op, F.col("p"), F.concat(F.lit("invalid page number "), F.col("p").cast("string")))


def extract_pages(pages: DataFrame, wanted: list[int]) -> tuple[DataFrame, DataFrame]:
    """Listed pages once each, in order; a document that lacks one fails whole."""
    if not wanted:
        raise ValueError("no pages given")
    bad = _beyond(pages, sorted(set(wanted)), "extract_pages")
    good = pages.where(F.col("page_no").isin(*set(wanted))).join(bad.select("doc_id").distinct(), "doc_id", "left_anti")
    return renumber(good, ["page_no"]), bad


def organize_pages(pages: DataFrame, order: list[int]) -> DataFrame:
    """Pages in exactly this order; repeats allowed, pages out of range left out."""
    table = F.posexplode(F.array(*map(F.lit, order)))
    wanted = pages.select("doc_id").distinct().select("doc_id", table.alias("__pos", "page_no"))
    return renumber(pages.join(wanted, ["doc_id", "page_no"]).withColumn("source_page", F.col("page_no")), ["__pos"]).drop("__pos")


def delete_pages(pages: DataFrame, gone: list[int]) -> tuple[DataFrame, DataFrame]:
    """Pages without the listed ones; documents that lack one are reported and lose the others."""
    return renumber(pages.where(~F.col("page_no").isin(*gone)), ["page_no"]), _beyond(pages, sorted(set(gone)), "delete_pages")


def insert_pages(pages: DataFrame, new: DataFrame, at: int) -> DataFrame:
    """new (doc_id, page_no, ...) goes before page at of its document; a position out of range appends."""
    n, add = page_counts(pages), page_counts(new).withColumnRenamed("n_pages", "n_new")
    here = F.when((F.lit(at) < 0) | (F.lit(at) > F.col("n_pages")), F.col("n_pages")).otherwise(F.lit(at))
    old = pages.join(n, "doc_id").join(add, "doc_id", "left").withColumn("page_no", (F.col("page_no") + F.when(F.col("page_no") >= here, F.coalesce("n_new", F.lit(0))).otherwise(0)).cast("int")).drop("n_pages", "n_new")
    put = new.join(n, "doc_id").withColumn("page_no", (F.col("page_no") + here).cast("int")).drop("n_pages")
    return old.unionByName(put, allowMissingColumns=True)


def blank_pages(pages: DataFrame, width: float = 595.0, height: float = 842.0) -> DataFrame:
    return pages.select("doc_id").distinct().select("doc_id", F.lit(0).alias("page_no"), F.lit("").alias("text"), F.lit(width).alias("width"), F.lit(height).alias("height"), F.lit(0).alias("rotation"))


def duplicate_page(pages: DataFrame, page: int, target: int | None = None) -> tuple[DataFrame, DataFrame]:
    """A copy of a page at target (default: after it); a target out of range is the end."""
    copy = pages.where(F.col("page_no") == page).withColumn("page_no", F.lit(0))
    return insert_pages(pages, copy, page + 1 if target is None else target), _beyond(pages, [page], "duplicate_page")


def move_page(pages: DataFrame, start: int, end: int) -> DataFrame:
    """The page at start taken out and put back at end; documents without both stay as they are."""
    p = F.col("page_no")
    moved = F.when(p == start, F.lit(end)).when((p > start) & (p <= end), p - 1).when((p < start) & (p >= end), p + 1).otherwise(p)
    fits = (F.col("n_pages") > start) & (F.col("n_pages") > end)
    return pages.join(page_counts(pages), "doc_id").withColumn("page_no", F.when(fits, moved).otherwise(p).cast("int")).drop("n_pages")


def rotate_pages(pages: DataFrame, degrees: int, only: list[int] | None = None, absolute: bool = False) -> DataFrame:
    """Turns the listed pages (all without a list) by or to degrees; absolute ones must be multiples of 90."""
    if absolute and degrees % 90:
        raise ValueError("rotation must be a multiple of 90")
    turned = F.lit(degrees % 360) if absolute else F.pmod(F.col("rotation") + degrees, F.lit(360))
    return pages.withColumn("rotation", (F.when(F.col("page_no").isin(*only), turned).otherwise(F.col("rotation")) if only is not None else turned).cast("int"))


def resize_pages(pages: DataFrame, size: Column) -> DataFrame:
    """width and height by a size name; unknown names keep the page. Content is not scaled."""
    table = F.create_map(*[x for k, (w, h) in SIZES.items() for x in (F.lit(k), F.struct(F.lit(w).alias("w"), F.lit(h).alias("h")))])
    return pages.withColumn("__s", F.element_at(table, size)).withColumn("width", F.coalesce("__s.w", "width")).withColumn("height", F.coalesce("__s.h", "height")).drop("__s")


def crop_pages(pages: DataFrame, left: Column, top: Column, right: Column, bottom: Column) -> tuple[DataFrame, DataFrame]:
    """Box of each page less four margins; a box without area is an error."""
    out = pages.withColumn("x0", left).withColumn("y0", top).withColumn("x1", F.col("width") - right).withColumn("y1", F.col("height") - bottom)
    good = (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0"))
    return out.where(good), errors(out.where(~good), "crop_pages", F.col("page_no"), F.lit("crop leaves no area"))


def remove_blank_pages(pages: DataFrame, images: DataFrame | None = None, drawings: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Pages that hold text, an image or a drawing, renumbered; and per document what went: removed (array), n_left."""
    blank = pages.where(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s", "")) == "").select("doc_id", "page_no")
    for other in (images, drawings):
        if other is not None:
            blank = blank.join(other.select("doc_id", "page_no").distinct(), ["doc_id", "page_no"], "left_anti")
    kept = pages.join(blank, ["doc_id", "page_no"], "left_anti")
    gone = blank.groupBy("doc_id").agg(F.sort_array(F.collect_list("page_no")).alias("removed"))
    report = page_counts(pages).join(gone, "doc_id", "left").select("doc_id", F.coalesce("removed", F.array().cast("array<int>")).alias("removed"), (F.col("n_pages") - F.coalesce(F.size("removed"), F.lit(0))).cast("long").alias("n_left"))
    return renumber(kept, ["page_no"]), report


def page_labels(pages: DataFrame, style: str = "arabic", prefix: str = "", suffix: str = "", start: int = 1) -> DataFrame:
    """label: prefix, the number of the page in a style, suffix."""
    return pages.withColumn("label", F.concat(F.lit(prefix), number_label(F.col("page_no") + start, style), F.lit(suffix)))


def page_templates(pages: DataFrame, header: str = "", footer: str = "", numbers: bool = True) -> DataFrame:
    """header and footer of each page; with numbers, {page} and {total} are filled in. A null doc_id is a document."""
    if not header and not footer:
        raise ValueError("header and footer are both empty")
    if numbers and "{total}" in header + footer:
        # counts are joined: a window would bring a document's pages together
        total = page_counts(pages).select(F.col("doc_id").alias("__d"), F.col("n_pages").alias("__total"))
        pages = pages.join(total, F.col("doc_id").eqNullSafe(F.col("__d"))).drop("__d")

    def filled(text: str) -> Column:
        out = F.lit(text)
        if numbers:
            out = F.replace(out, F.lit("{page}"), (F.col("page_no") + 1).cast("string"))
            out = F.replace(out, F.lit("{total}"), F.col("__total").cast("string")) if "{total}" in text else out
        return out

    return pages.withColumn("header", filled(header)).withColumn("footer", filled(footer)).drop("__total")


def corpus_numbers(pages: DataFrame, parts: int = 256) -> DataFrame:
    """Number of each page in the whole corpus, from 1: a prefix sum of page counts by parts of the ids.

    The parts are cut at approximate quantiles of the ids, dense or sparse, so each has a like
    share of the documents; only their sums, a row for each, meet in one task.
    """
    counts = page_counts(pages)
    cuts = counts.select(F.col("doc_id").cast("double").alias("x")).approxQuantile("x", [i / parts for i in range(1, parts)], 0.001)
    bounds = F.array(*[F.lit(int(c)) for c in sorted(set(cuts))]).cast("array<bigint>")
    counts = counts.withColumn("__p", F.size(F.filter(bounds, lambda c: c <= F.col("doc_id"))))
    sums = counts.groupBy("__p").agg(F.sum("n_pages").alias("__n"))
    so_far = lambda n, w: F.coalesce(F.sum(n).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    tops = sums.select("__p", so_far("__n", W.orderBy("__p")).alias("__t"))
    at = counts.join(tops, "__p").select("doc_id", (F.col("__t") + so_far("n_pages", W.partitionBy("__p").orderBy("doc_id"))).alias("__at"))
    return pages.join(at, "doc_id").withColumn("corpus_no", (F.col("__at") + F.col("page_no") + 1).cast("long")).drop("__at")


PAGE_OPS = ("delete", "duplicate", "to_front")


def replay_page_ops(counts: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Page ids of each document after its operations in order, each on what the last one left; and the operations that could not be done.

    counts: doc_id, n_pages. log: doc_id, seq, kind (delete, duplicate, to_front), arg; arg is
    taken modulo the pages there are, and the last page is never deleted. Only the page list
    is kept while the log goes by. Documents without operations have no row. Errors (doc_id,
    seq, kind, error) are an operation of another kind, one without an argument, and one on a
    document that is not in counts or has no pages; the others are done as if these were not
    there. A null doc_id is no document.
    """

    def step(state: list, op) -> None:
        ids = state[1]
        if op.kind not in PAGE_OPS or op.arg is None:
            return
        k = op.arg % len(ids)
        if op.kind == "delete" and len(ids) > 1:
            del ids[k]
        elif op.kind == "duplicate":
            ids.insert(k, ids[k])
        elif op.kind == "to_front":
            ids.insert(0, ids.pop(k))

    kind = log.schema["doc_id"].dataType.simpleString()
    rows = log.join(counts, "doc_id", "left").select("doc_id", "seq", "kind", F.col("arg").cast("long").alias("arg"), F.coalesce(F.col("n_pages"), F.lit(0)).cast("long").alias("n_pages"))
    known = F.col("n_pages") > 0
    reason = F.when(~known, "unknown document").when(F.col("kind").isNull() | ~F.col("kind").isin(*PAGE_OPS), "unknown operation").when(F.col("arg").isNull(), "no argument")
    errors = rows.withColumn("error", reason).where("error is not null").select("doc_id", "seq", "kind", "error")
    done = fold_by_key(rows.where(known), ["doc_id"], ["seq", "kind", "arg"], lambda op: [op.doc_id, list(range(op.n_pages))], step, tuple, f"doc_id {kind}, pages array<int>")
    return done, errors


class History:
    """States of an undo history, at most keep of them, and the place of the current one (-1: none)."""

    def __init__(self, keep: int, states: list | None = None, at: int = -1):
        self.keep, self.states, self.at = keep, states or [], at

    def do(self, kind: str, state) -> None:
        """An edit drops what could be redone and appends its state; undo and redo move inside the bounds; other kinds do nothing."""
        if kind == "edit":
            self.states[self.at + 1 :] = [state]
            del self.states[: -self.keep]
            self.at = len(self.states) - 1
        elif kind == "undo":
            self.at = max(self.at - 1, min(0, len(self.states) - 1))
        elif kind == "redo":
            self.at = min(self.at + 1, len(self.states) - 1)

    def shown(self) -> tuple:
        return len(self.states), self.at, self.states[self.at] if self.states else None


def replay_history(log: DataFrame, keep: int = 50) -> DataFrame:
    """Undo history of each session: log has session, seq, kind (edit, undo, redo) and state.

    An edit drops what could be redone and appends its state; undo and redo move inside the
    bounds; the newest keep states stay, and only they are kept while the log goes by. Rows
    of other kinds do nothing; a null session is one session. Returns session, n_states,
    cursor, current. streaming/history.py has the same over a stream.
    """
    session, state = (log.schema[c].dataType.simpleString() for c in ("session", "state"))
    rows = log.select("session", "seq", "kind", "state")
    return fold_by_key(rows, ["session"], ["seq", "kind"], lambda op: (op.session, History(keep)), lambda h, op: h[1].do(op.kind, op.state), lambda h: (h[0], *h[1].shown()), f"session {session}, n_states long, cursor long, current {state}")
