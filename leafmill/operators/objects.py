"""Annotations, images, forms, metadata and whole documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.operators.pages import errors

CANVAS = "array<struct<type:string,left:double,top:double,width:double,height:double,text:string,fontSize:double,fill:string,stroke:string,strokeWidth:double,src:string,path:array<array<string>>>>"
#: What each kind of canvas object becomes (fixed values).
KINDS = {"path": "ink", "line": "line", "rect": "square", "circle": "circle", "textbox": "freetext", "image": "stamp"}
TEXT_KINDS = ("text", "i-text", "textbox")
BORDERS = ("S", "D", "B", "I", "U")
#: Names of colour spaces by code (fixed values).
COLOUR_SPACES = ("DeviceGray", "DeviceRGB", "DeviceCMYK", "Indexed")


def canvas_annotations(canvas: DataFrame, zoom: float = 1.0) -> DataFrame:
    """Typed annotations of canvas payloads (doc_id, page_no, payload: JSON array or object with objects).

    Bad JSON gives no rows; objects that lack what their kind needs (left and top, with width
    and height for rectangles, lines and circles, a source for images), and blank texts, are
    left out; texts are 100 by 50 and images 100 by 100 if they don't say. Sizes are divided by zoom, in paths every number by its place: even ones are x.
    """
    body = F.when(F.ltrim("payload").startswith("["), F.col("payload")).otherwise(F.get_json_object("payload", "$.objects"))
    rows = canvas.select("doc_id", "page_no", F.posexplode(F.from_json(body, CANVAS)).alias("idx", "o"))
    raw = F.lower(F.col("o.type"))
    kind = F.when(raw.isin(*TEXT_KINDS), F.lit("textbox")).otherwise(raw)
    rows = rows.withColumn("kind", kind)
    o = lambda c: F.col(f"o.{c}")
    box = o("left").isNotNull() & o("top").isNotNull()
    sized = box & o("width").isNotNull() & o("height").isNotNull()
    some = lambda c: F.trim(F.coalesce(o(c), F.lit(""))) != ""
    valid = F.when(F.col("kind") == "path", F.size(o("path")) > 0).when(F.col("kind").isin("rect", "line", "circle"), sized).when(F.col("kind") == "image", box & some("src")).when(F.col("kind") == "textbox", box & some("text")).otherwise(F.lit(False))
    z = 1.0 / zoom
    w = F.coalesce(o("width"), F.lit(100.0))
    h = F.coalesce(o("height"), F.when(F.col("kind") == "image", 100.0).otherwise(50.0))
    table = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    points = F.flatten(F.transform(o("path"), lambda seg: F.transform(F.slice(seg, F.lit(2), F.greatest(F.size(seg) - 1, F.lit(0))), lambda x: x.try_cast("double") * z)))
    return rows.where(valid).select(
        "doc_id", "page_no", "idx", F.element_at(table, F.col("kind")).alias("type"),
        (o("left") * z).alias("x0"), (o("top") * z).alias("y0"), ((o("left") + w) * z).alias("x1"), ((o("top") + h) * z).alias("y1"),
        F.when(F.col("kind") == "textbox", o("text")).alias("contents"), F.coalesce(o("strokeWidth"), F.lit(1.0)).alias("border_width"),
        F.coalesce(F.when(F.col("kind") == "textbox", o("fill")).otherwise(o("stroke")), F.lit("#000000")).alias("stroke"), F.when(F.col("kind") == "path", points).alias("points"),
    )


def shape_annotations(shapes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bounding boxes and point counts of shapes (doc_id, page_no, idx, type, points); polygons need three points, others two."""
    least = F.when(F.col("type") == "polygon", 3).otherwise(2)
    n = F.size(F.coalesce("points", F.array().cast("array<struct<x:double,y:double>>")))
    x, y = F.transform("points", lambda p: p["x"]), F.transform("points", lambda p: p["y"])
    good = shapes.where(n >= least).select("doc_id", "page_no", "idx", "type", F.array_min(x).alias("x0"), F.array_min(y).alias("y0"), F.array_max(x).alias("x1"), F.array_max(y).alias("y1"), n.cast("long").alias("n_points"))
    return good, errors(shapes.where(n < least), "shape_annotations", F.col("idx"), F.concat(F.col("type"), F.lit(": too few points")))


def annotation_summary(annotations: DataFrame) -> DataFrame:
    """Annotations by type on each page, with the page's total."""
    per = annotations.groupBy("doc_id", "page_no", "type").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("doc_id", "page_no").agg(F.sum("n").alias("total"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("by_type"))


def annotation_select(annotations: DataFrame, keys: DataFrame, remove: bool = False) -> tuple[DataFrame, DataFrame]:
    """The annotations named by (doc_id, page_no, idx), or all others; keys that name none are errors."""
    k = keys.select("doc_id", "page_no", "idx").distinct()
    out = annotations.join(k, ["doc_id", "page_no", "idx"], "left_anti" if remove else "left_semi")
    lost = k.join(annotations, ["doc_id", "page_no", "idx"], "left_anti")
    return out, errors(lost, "annotation_select", F.col("idx"), F.lit("invalid index"))


def _last(edits: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """For each key the last value of each column that is not null, by seq where edits have it; edits of one seq count by their values."""
    if "seq" not in edits.columns:
        edits = edits.withColumn("seq", F.lit(0))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("seq", c))).alias(c)
    return edits.groupBy(*keys).agg(*[last(c) for c in columns])


def restyle_annotations(annotations: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """edits: doc_id, page_no, idx, stroke, fill, border_width, style (0 to 4), opacity, and seq where one annotation has several: they hold in this order. Null keeps what is there."""
    letters = F.array(*map(F.lit, BORDERS))
    bad = F.coalesce(~F.col("style").between(0, 4), F.lit(False))
    fields = ("stroke", "fill", "border_width", "border_style", "opacity")
    good = _last(edits.where(~bad).withColumn("border_style", F.get(letters, F.col("style"))), ["doc_id", "page_no", "idx"], list(fields))
    good = good.select("doc_id", "page_no", "idx", F.struct(*fields).alias("e"))
    out = annotations.join(good, ["doc_id", "page_no", "idx"], "left")
    keep = {c: F.coalesce(F.col(f"e.{c}"), F.col(c)) for c in fields}
    return out.withColumns(keep).drop("e"), errors(edits.where(bad), "restyle_annotations", F.col("idx"), F.concat(F.lit("unknown border style "), F.col("style").cast("string")))


def flatten_annotations(content: DataFrame, annotations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Content with the annotations as rows of it, and how many went in per document. The annotation table is then empty."""
    rows = annotations.select("doc_id", "page_no", F.lit("annotation").alias("kind"), F.coalesce("contents", F.lit("")).alias("text"))
    return content.select("doc_id", "page_no", F.lit("content").alias("kind"), "text").unionByName(rows), annotations.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_flattened"))


def page_comments(comments: DataFrame) -> DataFrame:
    """Comments that are not blank, by page, in order of time."""
    c = comments.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    return c.groupBy("doc_id", "page_no").agg(F.count(F.lit(1)).alias("n_comments"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "id", "text"))), lambda x: x["text"]), "\n").alias("texts"))


def image_inventory(images: DataFrame) -> DataFrame:
    """Image records with names for codes, and the aspect to three decimals where both sides are positive."""
    space = F.coalesce(F.get(F.array(*map(F.lit, COLOUR_SPACES)), F.col("color_space")), F.concat(F.lit("Unknown("), F.col("color_space").cast("string"), F.lit(")")))
    aspect = F.when((F.col("width") > 0) & (F.col("height") > 0), F.floor(F.col("width") * 1000.0 / F.col("height") + 0.5) / 1000)
    return images.select("doc_id", "page_no", "idx", "width", "height", "bits_per_component", space.alias("color_space_name"), F.coalesce("compression", F.lit("None")).alias("compression"), (F.col("mask") > 0).alias("has_mask"), "size_bytes", aspect.cast("double").alias("aspect_ratio"))


def images_by_page(images: DataFrame) -> DataFrame:
    return images.groupBy("doc_id", "page_no").agg(F.count(F.lit(1)).alias("n_images"), F.array_sort(F.collect_list(F.struct("idx", "width", "height", "size_bytes"))).alias("images"))


def content_areas(spans: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """Boxes of text blocks and of images that have a full box, by type."""
    text = spans.groupBy("doc_id", "page_no", F.col("block").alias("idx")).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")).withColumn("type", F.lit("text"))
    if images is None:
        return text
    full = images.where("x0 is not null and y0 is not null and x1 is not null and y1 is not null").select("doc_id", "page_no", "idx", "x0", "y0", "x1", "y1", F.lit("image").alias("type"))
    return text.unionByName(full)


def optimize_report(pages: DataFrame) -> DataFrame:
    """Size of each page's text before and after white space and repeated lines are taken out, with the saving in percent."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t]+", " ")))
    after = F.array_join(F.array_distinct(F.filter(lines, lambda x: x != "")), "\n")
    p = pages.select("doc_id", "page_no", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("before"), F.octet_length(after).cast("long").alias("after"))
    return p.withColumn("reduction", F.col("before") - F.col("after")).withColumn("percent", F.when(F.col("before") > 0, F.floor(F.col("reduction") * 10000.0 / F.col("before") + 0.5) / 100).otherwise(0.0).cast("double"))


def optimize_total(report: DataFrame) -> DataFrame:
    """One row for a whole corpus from optimize_report(): pages, sizes, reduction and percent (2 decimals, 0 where there was nothing)."""
    total = report.agg(F.count(F.lit(1)).alias("n_pages"), F.coalesce(F.sum("before"), F.lit(0)).alias("before"), F.coalesce(F.sum("after"), F.lit(0)).alias("after")).withColumn("reduction", F.col("before") - F.col("after"))
    return total.withColumn("percent", F.when(F.col("before") > 0, F.floor(F.col("reduction") * 10000.0 / F.col("before") + 0.5) / 100).otherwise(0.0).cast("double"))


def fill_forms(fields: DataFrame, values: DataFrame, lock: bool = False) -> tuple[DataFrame, DataFrame]:
    """Fields (doc_id, page_no, name, value, flags) with the value given for their document and name; unknown names are errors; lock sets the read-only bit.

    Of several values for one name the last by seq counts, where values have it, else the
    greatest; a null value keeps what is there.
    """
    given = _last(values, ["doc_id", "name"], ["value"]).withColumnRenamed("value", "__v")
    out = fields.join(given, ["doc_id", "name"], "left").withColumn("value", F.coalesce("__v", "value")).drop("__v")
    if lock:
        out = out.withColumn("flags", F.col("flags").bitwiseOR(F.lit(1)))
    lost = values.select("doc_id", "name").distinct().join(fields, ["doc_id", "name"], "left_anti")
    return out, errors(lost, "fill_forms", F.col("name"), F.lit("unknown field"))


def edit_metadata(props: Column, update: dict[str, str | None] | None = None, clear_key: str | None = None, clear: bool = False) -> Column:
    """A metadata map after an update (nulls ignored), with one existing key set to null, or with none left."""
    if clear:
        return F.map_filter(props, lambda k, v: F.lit(False))
    out = props
    new = {k: v for k, v in (update or {}).items() if v is not None}
    if new:
        out = F.map_concat(F.map_filter(out, lambda k, v: ~k.isin(*new)), F.create_map(*[F.lit(x) for kv in new.items() for x in kv]))
    if clear_key is not None:
        out = F.transform_values(out, lambda k, v: F.when(k != clear_key, v))
    return out


def object_tree(pages: DataFrame, spans: DataFrame, images: DataFrame, annotations: DataFrame, max_pages: int | None = None) -> DataFrame:
    """Text blocks, images and annotations of each page. Each is counted before the joins."""
    key = ["doc_id", "page_no"]
    if max_pages is not None:
        pages, spans, images, annotations = (x.where(F.col("page_no") < max_pages) for x in (pages, spans, images, annotations))
    out = pages.select(*key)
    for name, part in (("n_blocks", spans.select(*key, "block").distinct()), ("n_images", images), ("n_annotations", annotations)):
        out = out.join(part.groupBy(*key).agg(F.count(F.lit(1)).alias(name)), key, "left")
    return out.na.fill(0, ["n_blocks", "n_images", "n_annotations"])


def page_profile(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Corners and rotation of each page; and pages and extreme sizes of each document."""
    each = pages.select("doc_id", "page_no", "width", "height", F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.col("width").alias("x1"), F.col("height").alias("y1"), "rotation")
    return each, pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages"), F.min("width").alias("min_width"), F.max("width").alias("max_width"), F.min("height").alias("min_height"), F.max("height").alias("max_height"))


def version_filter(docs: DataFrame, header: str = "header", low: float = 1.4, high: float = 2.0) -> DataFrame:
    """Documents whose format version, as their header names it, is in range."""
    version = F.regexp_extract(header, r"^%PDF-(\d+\.\d+)", 1).try_cast("double")
    return docs.withColumn("version", version).where(F.col("version").between(low, high))


def compare_documents(pairs: DataFrame, pages: DataFrame) -> DataFrame:
    """Line by line difference of pairs (pair_id, left_id, right_id) up to the longer one: status same, changed, added or removed."""
    lines = pages.select("doc_id", "page_no", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
    key = ["pair_id", "page_no", "line_no"]
    a = pairs.select("pair_id", F.col("left_id").alias("doc_id")).join(lines, "doc_id").select(*key, F.col("line").alias("a"))
    b = pairs.select("pair_id", F.col("right_id").alias("doc_id")).join(lines, "doc_id").select(*key, F.col("line").alias("b"))
    status = F.when(F.col("a").isNull(), F.lit("added")).when(F.col("b").isNull(), F.lit("removed")).when(F.col("a") == F.col("b"), F.lit("same")).otherwise(F.lit("changed"))
    return a.join(b, key, "full_outer").select(*key, status.alias("status"))


def comparison_summary(diff: DataFrame) -> DataFrame:
    return diff.groupBy("pair_id", "page_no").agg(*[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("same", "changed", "added", "removed")])


