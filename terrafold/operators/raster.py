"""Grids of pixels (row, col, values): blocks, neighbourhoods, components, distances, overviews and areas."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrafold.sources.tables import saved, spread


def grid_pixels(spark: SparkSession, rows: int, cols: int) -> DataFrame:
    return spark.range(rows * cols).select(F.floor(F.col("id") / cols).cast("int").alias("row"), (F.col("id") % cols).cast("int").alias("col"))


def block_of(size: int = 256) -> tuple[Column, Column]:
    return F.floor(F.col("row") / size).cast("int").alias("block_row"), F.floor(F.col("col") / size).cast("int").alias("block_col")


def blocks(pixels: DataFrame, size: int = 256) -> DataFrame:
    """Each block with its extent and number of pixels."""
    return pixels.groupBy(*block_of(size)).agg(
        F.min("row").alias("first_row"), F.min("col").alias("first_col"), (F.max("row") - F.min("row") + 1).alias("height"), (F.max("col") - F.min("col") + 1).alias("width"), F.count(F.lit(1)).alias("n"))


def _offsets(reach: int = 1) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("dr"), F.lit(j).alias("dc")) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)])


def neighbours(pixels: DataFrame, values: list[str]) -> DataFrame:
    """``row, col, dr, dc`` and the values of the up to eight neighbours of each pixel."""
    moved = pixels.select("row", "col", *values, F.explode(_offsets()).alias("o")).where("o.dr <> 0 or o.dc <> 0")
    return moved.select((F.col("row") - F.col("o.dr")).alias("row"), (F.col("col") - F.col("o.dc")).alias("col"), F.col("o.dr").alias("dr"), F.col("o.dc").alias("dc"), *values)


def dilate(pixels: DataFrame) -> DataFrame:
    """The flagged pixels and their neighbours."""
    return pixels.select("row", "col", F.explode(_offsets()).alias("o")).select((F.col("row") + F.col("o.dr")).alias("row"), (F.col("col") + F.col("o.dc")).alias("col")).distinct()


def _block_labeller(within: tuple[str, ...]):
    """A function that gives each flagged pixel of one block the first pixel of its component there.

    It is made here, not at the top of the module, so that it travels to workers whole.
    """
    def label(cells: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values(["row", "col"], ignore_index=True)
        row, col = cells["row"].to_numpy(), cells["col"].to_numpy()
        at = np.full((row.max() - row.min() + 2, col.max() - col.min() + 3), -1)  # with a border to the south and on both sides
        r, c = row - row.min(), col - col.min() + 1
        at[r, c] = np.arange(len(cells))
        pairs = [(at[r, c], at[r + i, c + j]) for i, j in ((0, 1), (1, -1), (1, 0), (1, 1))]
        one, other = (np.concatenate(x) for x in zip(*[(x[y >= 0], y[y >= 0]) for x, y in pairs]))
        first = np.arange(len(cells))
        while len(one):
            a, b = first[one], first[other]
            np.minimum.at(first, np.maximum(a, b), np.minimum(a, b))
            while (first[first] != first).any():
                first = first[first]
            open_ = first[one] != first[other]
            one, other = one[open_], other[open_]
        return cells[[*within, "row", "col"]].assign(row0=row[first], col0=col[first])

    return label


def patches(pixels: DataFrame, least: int = 1, within: tuple[str, ...] = (), block: int = 256) -> DataFrame:
    """``row, col, patch, size``: 8-connected components of the flagged pixels (of each image, if ``within`` names its key), named by their first pixel.

    Blocks are solved for themselves; their components are then linked where blocks meet. Each round takes the smallest label around and then
    that label's label, of these components only; it ends when nothing changes.
    """
    key = lambda r, c: F.struct(*within, F.col(r).alias("row"), F.col(c).alias("col")) if within else F.col(r).cast("long") * (1 << 31) + F.col(c)
    flagged = pixels.select(*within, F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"))
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in flagged.schema)
    cells = saved(flagged.groupBy(*within, *block_of(block)).applyInPandas(_block_labeller(within), f"{shape}, row0 int, col0 int").select(*within, "row", "col", key("row0", "col0").alias("part")), "cells")
    border = cells.where((F.pmod("row", F.lit(block)).isin(0, block - 1)) | (F.pmod("col", F.lit(block)).isin(0, block - 1)))
    near = border.select(*within, F.col("part").alias("cell"), "row", "col", F.explode(_offsets()).alias("o")).select(*within, "cell", (F.col("row") + F.col("o.dr")).alias("row"), (F.col("col") + F.col("o.dc")).alias("col"))
    links = saved(spread(near).join(border.withColumnRenamed("part", "other"), [*within, "row", "col"]).where("cell <> other").select("cell", "other").distinct(), "links")
    labels = saved(links.select("cell", F.col("cell").alias("patch")).distinct(), "labels")
    linked = not links.isEmpty()
    while linked:
        around = spread(links).join(labels.withColumnRenamed("cell", "other"), "other").groupBy("cell").agg(F.min("patch").alias("low"))
        jump = labels.select(F.col("cell").alias("low"), F.col("patch").alias("lower"))
        met = labels.join(spread(around), "cell").withColumn("low", F.least("low", "patch"))
        step = saved(met.join(spread(jump), "low").select("cell", F.col("patch").alias("old"), F.least("low", "lower").alias("patch")), "labels")
        labels = step.select("cell", "patch")
        linked = not step.where("old <> patch").isEmpty()
    named = cells.join(spread(labels.withColumnRenamed("cell", "part")), "part", "left").select(*within, "row", "col", F.coalesce("patch", "part").alias("patch"))
    sizes = named.groupBy("patch").agg(F.count(F.lit(1)).alias("size"))
    return named.join(spread(sizes), "patch").where(F.col("size") >= least).select(*within, "row", "col", "patch", "size")


def bounded_distance(pixels: DataFrame, marked: DataFrame, reach: int, cell: float) -> DataFrame:
    """Exact distance of each pixel to the nearest marked one within ``reach`` pixels, else null.

    Two passes: the nearest marked row in each column, then the best column within reach.
    """
    reached = marked.select("col", F.explode(F.sequence(F.col("row") - reach, F.col("row") + reach)).alias("row"), F.col("row").alias("at"))
    vertical = reached.groupBy("row", "col").agg(F.min(F.pow(F.col("row") - F.col("at"), F.lit(2))).alias("v2"))
    sideways = vertical.select("row", F.explode(F.sequence(F.col("col") - reach, F.col("col") + reach)).alias("to"), "col", "v2")
    best = sideways.groupBy("row", F.col("to").alias("col")).agg(F.min(F.col("v2") + F.pow(F.col("to") - F.col("col"), F.lit(2))).alias("d2"))
    d = F.when(F.col("d2") <= reach * reach, F.sqrt("d2") * cell)
    return pixels.join(spread(best), ["row", "col"], "left").select("row", "col", d.alias("d"))


def overview_mode(pixels: DataFrame, code: str, factor: int) -> DataFrame:
    """The most frequent code of each coarse pixel; the lowest of equals."""
    counts = pixels.where(F.col(code).isNotNull()).groupBy(F.floor(F.col("row") / factor).cast("int").alias("row"), F.floor(F.col("col") / factor).cast("int").alias("col"), code).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("row", "col").agg(F.max_by(code, F.struct(F.col("n"), -F.col(code))).alias(code), F.sum("n").alias("n_valid"))


def overview_mean(pixels: DataFrame, value: str, factor: int) -> DataFrame:
    return pixels.groupBy(F.floor(F.col("row") / factor).cast("int").alias("row"), F.floor(F.col("col") / factor).cast("int").alias("col")).agg(F.avg(value).alias("mean"), F.count(value).alias("n_valid"))


def areas(pixels: DataFrame, code: str, cell: float = 10.0) -> DataFrame:
    """Pixels and hectares of each code; null is no data."""
    return pixels.groupBy(code).agg(F.count(F.lit(1)).alias("pixels"), (F.count(F.lit(1)) * (cell * cell / 10000)).alias("hectares"))


def terrain(pixels: DataFrame, z: str, cell: float) -> DataFrame:
    """Slope in degrees, aspect as north and east parts, and curvature, by central differences (one-sided at edges)."""
    by_row, by_col = Window.partitionBy("col").orderBy("row"), Window.partitionBy("row").orderBy("col")
    def slope_along(w):
        before, after = F.lag(z).over(w), F.lead(z).over(w)
        return F.when(before.isNull(), after - F.col(z)).when(after.isNull(), F.col(z) - before).otherwise((after - before) / 2) / cell
    out = pixels.withColumns({"dzdy": slope_along(by_row), "dzdx": slope_along(by_col)})
    around = F.lag(z).over(by_row) + F.lead(z).over(by_row) + F.lag(z).over(by_col) + F.lead(z).over(by_col)
    aspect = F.atan2(-F.col("dzdx"), F.col("dzdy"))
    return out.withColumns({"slope": F.degrees(F.atan(F.hypot("dzdx", "dzdy"))), "north": F.cos(aspect), "east": F.sin(aspect), "curvature": (around - 4 * F.col(z)) / (cell * cell)})


def raster_lines(segments: DataFrame, cell: float) -> DataFrame:
    """Pixels (half-open squares) that a segment (ax, ay, bx, by) touches.

    Along its longer axis a segment meets one line of pixels after the other, and in each the few between the places where
    it enters and leaves. Where it leaves through a corner, the pixel beyond belongs to the next line.
    """
    s = segments.select(*[(F.col(c) / cell).alias(c) for c in ("ax", "ay", "bx", "by")]).withColumn("steep", F.abs(F.col("by") - F.col("ay")) > F.abs(F.col("bx") - F.col("ax")))
    pick = lambda a, b: F.when(F.col("steep"), F.col(a)).otherwise(F.col(b))
    s = s.select("steep", pick("ay", "ax").alias("u0"), pick("by", "bx").alias("u1"), pick("ax", "ay").alias("v0"), pick("bx", "by").alias("v1"))
    s = s.withColumns({"low": F.least("u0", "u1"), "high": F.greatest("u0", "u1")}).withColumn("u", F.explode(F.sequence(F.floor("low").cast("int"), F.floor("high").cast("int"))))
    at = lambda u: F.col("v0") + F.coalesce(F.try_divide(u - F.col("u0"), F.col("u1") - F.col("u0")), F.lit(0.0)) * (F.col("v1") - F.col("v0"))
    s = s.withColumns({"e0": at(F.greatest(F.col("low"), F.col("u").cast("double"))), "e1": at(F.least(F.col("high"), F.col("u") + 1.0))})
    goes_on = (F.col("u") + 1 <= F.col("high")) & (F.col("e1") > F.col("e0"))
    last = F.when(goes_on, F.ceil("e1") - 1).otherwise(F.floor(F.greatest("e0", "e1")))
    s = s.withColumn("v", F.explode(F.sequence(F.floor(F.least("e0", "e1")).cast("int"), last.cast("int"))))
    return s.select(F.when(F.col("steep"), F.col("u")).otherwise(F.col("v")).alias("row"), F.when(F.col("steep"), F.col("v")).otherwise(F.col("u")).alias("col")).distinct()


def bilinear(points: DataFrame, pixels: DataFrame, value: str) -> DataFrame:
    """Value at fractional positions (r, c) from the four pixels around; null where one is missing."""
    corner = points.withColumns({"r0": F.floor("r").cast("int"), "c0": F.floor("c").cast("int")})
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])
    keys = corner.withColumn("o", F.explode(around)).withColumns({"row": F.col("r0") + F.col("o.i"), "col": F.col("c0") + F.col("o.j")})
    fr, fc = F.col("r") - F.col("r0"), F.col("c") - F.col("c0")
    weight = F.when(F.col("o.i") == 1, fr).otherwise(1 - fr) * F.when(F.col("o.j") == 1, fc).otherwise(1 - fc)
    met = spread(keys).join(pixels.select("row", "col", F.col(value).alias("v")), ["row", "col"], "left")
    return met.groupBy("from_id").agg(F.when(F.count_if((weight > 0) & F.col("v").isNull()) == 0, F.sum(F.when(weight > 0, weight * F.col("v")).otherwise(F.lit(0.0)))).alias("value"))


def texture(pixels: DataFrame, level: str, levels: int = 32) -> DataFrame:
    """Co-occurrence of grey levels over four directions: contrast, homogeneity and energy, for each window."""
    right = F.array(*[F.struct(F.lit(i).alias("dr"), F.lit(j).alias("dc")) for i, j in ((0, 1), (1, 0), (1, 1), (1, -1))])
    a = pixels.select("window", "row", "col", F.col(level).alias("i"), F.explode(right).alias("o"))
    a = a.select("window", (F.col("row") + F.col("o.dr")).alias("row"), (F.col("col") + F.col("o.dc")).alias("col"), "i")
    pairs = spread(a).join(pixels.select("window", "row", "col", F.col(level).alias("j")), ["window", "row", "col"])
    both = pairs.select("window", "i", "j").union(pairs.select("window", F.col("j").alias("i"), F.col("i").alias("j")))
    counts = both.groupBy("window", "i", "j").agg(F.count(F.lit(1)).alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy("window"))  # at most levels * levels rows a window
    d2 = F.pow(F.col("i") - F.col("j"), F.lit(2))
    return counts.withColumn("p", p).groupBy("window").agg(F.sum(F.col("p") * d2).alias("contrast"), F.sum(F.col("p") / (1 + d2)).alias("homogeneity"), F.sqrt(F.sum(F.col("p") * F.col("p"))).alias("energy"))


def flag_water(ndwi: Column, slope: Column, least: float = 0.05, flat: float = 15.0) -> Column:
    return F.coalesce((ndwi > least) & (slope < flat), F.lit(False))


def useful_blocks(pixels: DataFrame, allowed: Column, size: int = 256) -> DataFrame:
    """Blocks with at least one allowed pixel, and whether all of their pixels are."""
    seen = pixels.groupBy(*block_of(size)).agg(F.count_if(allowed).alias("n_allowed"), F.count(F.lit(1)).alias("n"))
    return seen.where("n_allowed > 0").withColumn("whole", F.col("n_allowed") == F.col("n"))


def viewport(screen: DataFrame, pixels: DataFrame, value: str) -> DataFrame:
    """Screen cells (sx, sy, row, col as fractions) with the nearest pixel's value."""
    near = screen.withColumns({"row": F.floor("row").cast("int"), "col": F.floor("col").cast("int")})
    return spread(near).join(pixels.select("row", "col", value), ["row", "col"], "left").select("sx", "sy", value)


def compared(samples_: DataFrame, mapped: DataFrame, real: str, code: str) -> DataFrame:
    """Counts of sample class against map class at the samples' pixels; null where the map has none."""
    return samples_.join(mapped.select("row", "col", code), ["row", "col"], "left").groupBy(real, code).agg(F.count(F.lit(1)).alias("n"))


def laplacian(pixels: DataFrame, z: str) -> DataFrame:
    """``row, col, curvature``: the sum of the eight neighbours less eight times the pixel; null where a neighbour is missing."""
    near = neighbours(pixels, [z]).groupBy("row", "col").agg(F.count(z).alias("n"), F.sum(z).alias("sum"))
    return pixels.select("row", "col", z).join(spread(near), ["row", "col"], "left").select("row", "col", F.when(F.col("n") == 8, F.col("sum") - 8 * F.col(z)).alias("curvature"))


def centre_and_ring(pixels: DataFrame, value: str, side: int, limit: float = 0.18) -> DataFrame:
    """Statistics of the middle of each window (a quarter of the side to either side of its centre) against the ring around:
    median, 90th percentile, deviation, share above a limit, and the contrast of the medians. At most side * side rows a window."""
    reach, middle = max(1, side // 4), side // 2
    centre = F.col("row").between(middle - reach, middle + reach - 1) & F.col("col").between(middle - reach, middle + reach - 1)
    inner, outer = F.when(centre, F.col(value)), F.when(~centre, F.col(value))
    return pixels.groupBy("window").agg(
        F.median(inner).alias("median"), F.percentile(inner, F.lit(0.9)).alias("p90"), F.stddev_pop(inner).alias("sd"),
        F.avg((inner > limit).cast("double")).alias("share"), (F.median(inner) - F.median(outer)).alias("contrast"))


def pyramid(pixels: DataFrame, code: str, largest: int, least: int = 256) -> DataFrame:
    """Overviews at factors 2, 4, ... while the larger side still has ``least`` pixels: ``factor, row, col, code, n_valid``."""
    out, factor = None, 2
    while largest / factor >= least or out is None:
        level = overview_mode(pixels, code, factor).select(F.lit(factor).alias("factor"), "row", "col", code, "n_valid")
        out, factor = level if out is None else out.union(level), factor * 2
    return out


def largest_polygons(edges: DataFrame, n: int = 400) -> DataFrame:
    """The n polygons of the largest area (by the edges' cross products), for a preview; the lowest name of equals first."""
    area = F.abs(F.sum(F.col("ax") * F.col("by") - F.col("bx") * F.col("ay"))) / 2
    return edges.groupBy("polygon").agg(area.alias("area")).orderBy(F.desc("area"), "polygon").limit(n)
