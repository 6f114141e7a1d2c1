"""Polygons on a grid as runs of pixels (row, col_from, col_to): scan lines, set operations, touched pixels and zones to map.

A grid is its north-western corner, its cell and, where they matter, its size; rows grow southwards. Polygons come as
edges (polygon, ax, ay, bx, by); holes are rings of the same polygon. A pixel is inside where its centre is; a centre on an
edge counts on one side of it only (left and lower borders are inside), so that neighbouring polygons share no pixel.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrafold.operators.raster import raster_lines
from terrafold.sources.tables import spread

MOST_BLOCKS = 20_000
#: Columns of a piece of a run, by which pixels meet runs.
PIECE = 64


@dataclass(frozen=True)
class Grid:
    """West edge, north edge and cell in metres; columns and rows."""

    x0: float
    y0: float
    cell: float
    width: int = 0
    height: int = 0

    def widened(self, pixels: int) -> Grid:
        """The grid with so many pixels more on every side."""
        return Grid(self.x0 - pixels * self.cell, self.y0 + pixels * self.cell, self.cell, self.width + 2 * pixels, self.height + 2 * pixels)

    def centre(self) -> tuple[Column, Column]:
        """x and y of the centre of each pixel (row, col)."""
        return self.x0 + (F.col("col") + 0.5) * self.cell, self.y0 - (F.col("row") + 0.5) * self.cell


def ring_edges(rings: DataFrame) -> DataFrame:
    """Edges of rings (polygon, ring, at, x, y), each closed by an edge from its last point to its first; points in a row that are
    equal give none. A ring's points are in one window."""
    w = Window.partitionBy("polygon", "ring").orderBy("at")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    to = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(whole))
    edges = rings.select("polygon", F.col("x").alias("ax"), F.col("y").alias("ay"), to("x").alias("bx"), to("y").alias("by"))
    return edges.where("ax <> bx or ay <> by")


def centre_runs(edges: DataFrame, grid: Grid) -> DataFrame:
    """Runs of the pixels whose centre lies in a polygon, of each polygon for itself: ``polygon, row, col_from, col_to``.

    An edge gives one crossing for each row of centres that it passes; crossings of a polygon and row pair up from left to right.
    """
    c = grid.cell
    place = lambda y: F.floor((grid.y0 - y) / c - 0.5)
    dealt = edges.withColumns({"lo": place(F.greatest("ay", "by")) + 1, "hi": place(F.least("ay", "by"))}).where("lo <= hi").withColumn("row", F.explode(F.sequence("lo", "hi")))
    y = grid.y0 - (F.col("row") + 0.5) * c
    cut = dealt.select("polygon", "row", (F.col("ax") + (y - F.col("ay")) * (F.col("bx") - F.col("ax")) / (F.col("by") - F.col("ay"))).alias("x"))
    w = Window.partitionBy("polygon", "row").orderBy("x")
    pairs = cut.withColumns({"n": F.row_number().over(w), "x2": F.lead("x").over(w)}).where("n % 2 = 1 and x2 is not null")
    at = lambda x: F.ceil((F.col(x) - grid.x0) / c - 0.5)
    runs = pairs.select("polygon", F.col("row").cast("int").alias("row"), at("x").cast("int").alias("col_from"), (at("x2") - 1).cast("int").alias("col_to"))
    return runs.where("col_from <= col_to")


def swept(runs: DataFrame, least: int, within: tuple[str, ...] = ()) -> DataFrame:
    """The longest runs in which every pixel is in at least ``least`` of the given runs: a sweep along each row (of each image, if
    ``within`` names its key), no pairs of runs."""
    keys = [*within, "row"]
    ends = F.array(F.struct(F.col("col_from").alias("at"), F.lit(1).alias("step")), F.struct((F.col("col_to") + 1).alias("at"), F.lit(-1).alias("step")))
    turns = runs.select(*keys, F.inline(ends)).groupBy(*keys, "at").agg(F.sum("step").alias("step"))
    w = Window.partitionBy(*keys).orderBy("at")
    inside = turns.withColumn("inside", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)) >= least)
    changed = inside.withColumn("was", F.lag("inside", 1, False).over(w)).where("inside <> was")
    return changed.withColumn("end", F.lead("at").over(w)).where("inside").select(*keys, F.col("at").alias("col_from"), (F.col("end") - 1).alias("col_to"))


def union(*sets: DataFrame) -> DataFrame:
    """Runs of the pixels in any of the sets."""
    out = sets[0].select("row", "col_from", "col_to")
    for one in sets[1:]:
        out = out.union(one.select("row", "col_from", "col_to"))
    return swept(out, 1)


def intersection(*sets: DataFrame) -> DataFrame:
    """Runs of the pixels in all of the sets."""
    each = [swept(one.select("row", "col_from", "col_to"), 1) for one in sets]
    out = each[0]
    for one in each[1:]:
        out = out.union(one)
    return swept(out, len(each))


def zone_runs(edges: DataFrame, grid: Grid) -> DataFrame:
    """Runs of the pixels whose centre lies in any polygon."""
    return union(centre_runs(edges, grid))


def touched_runs(edges: DataFrame, grid: Grid, filled: bool = True) -> DataFrame:
    """Runs of the pixels that lines touch or, filled, that polygons touch. A pixel is its square with its upper and left sides."""
    moved = edges.select(*[((F.col(c) - grid.x0) if c in ("ax", "bx") else (grid.y0 - F.col(c))).alias(c) for c in ("ax", "ay", "bx", "by")])
    border = raster_lines(moved, grid.cell).select("row", F.col("col").alias("col_from"), F.col("col").alias("col_to"))
    return union(border, centre_runs(edges, grid)) if filled else union(border)


def clipped(runs: DataFrame, grid: Grid) -> DataFrame:
    """The part of the runs on the grid."""
    held = runs.where((F.col("row") >= 0) & (F.col("row") < grid.height))
    return held.select("row", F.greatest("col_from", F.lit(0)).alias("col_from"), F.least("col_to", F.lit(grid.width - 1)).alias("col_to")).where("col_from <= col_to")


def moved(runs: DataFrame, rows: int, cols: int) -> DataFrame:
    """The runs on a grid that begins so many rows and columns later."""
    return runs.select((F.col("row") - rows).alias("row"), (F.col("col_from") - cols).alias("col_from"), (F.col("col_to") - cols).alias("col_to"))


def run_pixels(runs: DataFrame) -> DataFrame:
    """``row, col`` of every pixel of the runs, which don't overlap."""
    return runs.select("row", F.explode(F.sequence("col_from", "col_to")).alias("col"))


def run_area(runs: DataFrame, cell: float) -> DataFrame:
    """One row: pixels and hectares of runs that don't overlap."""
    n = F.coalesce(F.sum(F.col("col_to") - F.col("col_from") + 1), F.lit(0)).cast("long")
    return runs.agg(n.alias("pixels"), (n * (cell * cell / 10000)).alias("hectares"))


def in_runs(pixels: DataFrame, runs: DataFrame) -> DataFrame:
    """``pixels`` with ``inside``. Runs are cut into pieces of ``PIECE`` columns, so a pixel meets only those of its own piece."""
    pieces = runs.withColumn("piece_", F.explode(F.sequence(F.floor(F.col("col_from") / PIECE), F.floor(F.col("col_to") / PIECE)))).withColumnRenamed("row", "row_")
    met = pixels.withColumn("piece_at_", F.floor(F.col("col") / PIECE))
    on = (met["row"] == pieces["row_"]) & (met["piece_at_"] == pieces["piece_"]) & (met["col"] >= pieces["col_from"]) & (met["col"] <= pieces["col_to"])
    return met.join(spread(pieces), on, "left").withColumn("inside", F.col("col_from").isNotNull()).drop("row_", "piece_", "piece_at_", "col_from", "col_to")


def box_edges(spark, box: tuple[float, float, float, float]) -> DataFrame:
    """Edges of a rectangle (min x, min y, max x, max y)."""
    x, y, x1, y1 = map(float, box)
    return spark.createDataFrame([(0, x, y, x1, y), (0, x1, y, x1, y1), (0, x1, y1, x, y1), (0, x, y1, x, y)], "polygon int, ax double, ay double, bx double, by double")


def bounds(edges: DataFrame) -> DataFrame:
    """One row: the box of the edges, and the sum of their polygons' areas (holes may turn either way and count as area too)."""
    box = edges.agg(F.min(F.least("ax", "bx")).alias("x0"), F.min(F.least("ay", "by")).alias("y1"), F.max(F.greatest("ax", "bx")).alias("x1"), F.max(F.greatest("ay", "by")).alias("y0"))
    area = edges.groupBy("polygon").agg(F.abs(F.sum(F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")) / 2).alias("a")).agg(F.coalesce(F.sum("a"), F.lit(0.0)).alias("area"))
    return box.crossJoin(area)


def _around(west: float, south: float, east: float, north: float, cell: float) -> Grid:
    from math import ceil, floor

    x0, y0 = floor(west / cell) * cell, ceil(north / cell) * cell
    return Grid(x0, y0, cell, max(ceil((east - x0) / cell), 1), max(ceil((y0 - south) / cell), 1))


@dataclass(frozen=True)
class Zone:
    """What is to be mapped: the grid around it and its runs there; or ``problem``: no surface, mask outside, too large."""

    problem: str | None
    grid: Grid | None = None
    runs: DataFrame | None = None
    blocks: int = 0


def prepare_zone(cell: float, zone: DataFrame | None = None, mask: DataFrame | None = None, block: int = 256, most: int = MOST_BLOCKS) -> Zone:
    """The grid and the runs of a zone (edges), of the part of it within a mask (edges), or of the whole mask.

    The grid lies on multiples of the cell and fits what is to be classified. Only boxes (one row each) come to the driver.
    """
    if zone is None and mask is None:
        raise ValueError("a zone or a mask is needed")
    frame = mask if zone is None else zone
    box = bounds(frame).first()
    if box.x0 is None or not box.area > 0 or not (box.x1 > box.x0 and box.y0 > box.y1):
        return Zone("no surface")
    grid = _around(box.x0, box.y1, box.x1, box.y0, cell)
    runs = clipped(zone_runs(frame, grid), grid)
    if zone is not None and mask is not None:
        both = clipped(intersection(touched_runs(zone, grid), touched_runs(mask, grid)), grid)
        inner = clipped(intersection(runs, zone_runs(mask, grid)), grid)
        at = both.agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col_from").alias("c0"), F.max("col_to").alias("c1")).first()
        if at.r0 is None or inner.isEmpty():
            return Zone("mask outside")
        grid = Grid(grid.x0 + at.c0 * cell, grid.y0 - at.r0 * cell, cell, at.c1 - at.c0 + 1, at.r1 - at.r0 + 1)
        runs = moved(inner, at.r0, at.c0)
    blocks = -(-grid.width // block) * -(-grid.height // block)
    return Zone("too large", blocks=blocks) if blocks > most else Zone(None, grid, runs, blocks)
