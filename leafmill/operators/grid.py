"""Which boxes hold a point, and which boxes overlap, on pages of any number of either: equi-joins by cells of a grid.

Boxes are laid on grids whose cells are powers of two wide and high, each on the one whose
cells are just as wide and as high as itself or more, so it touches four cells at most. A point
is looked up once on each grid that its page has in use, which are few: only sizes count.
Two kinds of boxes meet on the coarser grid of the two, by width and by height. Every pair is
found on just one grid; what shares a cell without touching is dropped by the exact condition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE = ["doc_id", "page_no"]
#: Boxes smaller than a cell of this power of two are on its grid, larger than the last on that one.
LEAST, MOST = -10, 40


def _level(low: Column, high: Column) -> Column:
    """The power of two that is as large as the side."""
    return F.greatest(F.lit(LEAST), F.least(F.lit(MOST), F.ceil(F.log2(F.greatest(high - low, F.lit(2.0**LEAST)))))).cast("int")


def _cell(at: Column, level: Column) -> Column:
    return F.floor(at / F.pow(F.lit(2.0), level)).cast("long")


def _cells(low: Column, high: Column, level: Column) -> Column:
    return F.explode(F.sequence(_cell(low, level), _cell(high, level)))


def laid(boxes: DataFrame, x0: str, y0: str, x1: str, y1: str) -> DataFrame:
    """Boxes with all four sides in order, and the levels of their grid: lx, ly."""
    whole = boxes.where((F.col(x0) <= F.col(x1)) & (F.col(y0) <= F.col(y1)))
    return whole.withColumn("lx", _level(F.col(x0), F.col(x1))).withColumn("ly", _level(F.col(y0), F.col(y1)))


def grids(boxes: DataFrame) -> DataFrame:
    """The grids in use on each page, as one array."""
    return boxes.groupBy(*PAGE).agg(F.collect_set(F.struct("lx", "ly")).alias("grids"))


def boxes_at_points(boxes: DataFrame, points: DataFrame, carry: list[str]) -> DataFrame:
    """point_id and the carried columns of every box (doc_id, page_no, x0, y0, x1, y1) that holds the point (point_id, doc_id, page_no, x, y), edges included."""
    b = laid(boxes.select(*PAGE, "x0", "y0", "x1", "y1", *carry), "x0", "y0", "x1", "y1")
    p = points.select("point_id", *PAGE, "x", "y").join(grids(b), PAGE).withColumn("g", F.explode("grids"))
    p = p.select("point_id", *PAGE, "x", "y", "g.lx", "g.ly", _cell(F.col("x"), F.col("g.lx")).alias("cx"), _cell(F.col("y"), F.col("g.ly")).alias("cy"))
    b = b.withColumn("cx", _cells(F.col("x0"), F.col("x1"), F.col("lx"))).withColumn("cy", _cells(F.col("y0"), F.col("y1"), F.col("ly")))
    return p.join(b, [*PAGE, "lx", "ly", "cx", "cy"]).where("x between x0 and x1 and y between y0 and y1").select("point_id", *carry)


def overlapping(boxes: DataFrame, regions: DataFrame, carry: list[str]) -> DataFrame:
    """The carried columns, each once, of the boxes that overlap a region (doc_id, page_no, rx0, ry0, rx1, ry1) of their page; touching is no overlap."""
    b = laid(boxes.select(*PAGE, "x0", "y0", "x1", "y1", *[c for c in carry if c not in (*PAGE, "x0", "y0", "x1", "y1")]), "x0", "y0", "x1", "y1")
    r = laid(regions.select(*PAGE, "rx0", "ry0", "rx1", "ry1").distinct(), "rx0", "ry0", "rx1", "ry1").withColumnsRenamed({"lx": "mx", "ly": "my"})
    on_boxes, on_regions = grids(b), grids(r.withColumnsRenamed({"mx": "lx", "my": "ly"}))
    b = b.join(on_regions, PAGE).withColumn("g", F.explode("grids")).withColumns({"mx": F.col("g.lx"), "my": F.col("g.ly")}).drop("g", "grids")
    r = r.join(on_boxes, PAGE).withColumn("g", F.explode("grids")).withColumns({"lx": F.col("g.lx"), "ly": F.col("g.ly")}).drop("g", "grids")
    wide, high = F.greatest("lx", "mx"), F.greatest("ly", "my")
    b = b.withColumn("cx", _cells(F.col("x0"), F.col("x1"), wide)).withColumn("cy", _cells(F.col("y0"), F.col("y1"), high))
    r = r.withColumn("cx", _cells(F.col("rx0"), F.col("rx1"), wide)).withColumn("cy", _cells(F.col("ry0"), F.col("ry1"), high))
    found = b.join(r, [*PAGE, "lx", "ly", "mx", "my", "cx", "cy"])
    return found.where("x0 < rx1 and x1 > rx0 and y0 < ry1 and y1 > ry0").select(*carry).distinct()
