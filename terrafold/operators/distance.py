"""Exact Euclidean distances of the pixels of a grid to marked pixels and to points, at any distance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrafold.operators.zones import Grid
from terrafold.sources.tables import spread

#: Pixels of a strip that one task solves, if one line of the grid is not longer.
STRIP = 1 << 18


def _strip_solver(size: int):
    """A function that solves one strip: its pixels, and of every line across it the marks inside and the nearest beyond.

    All that it calls is made here, so that it travels to workers whole.
    """
    def nearest(inside: list[np.ndarray], before: np.ndarray, after: np.ndarray, first: int, n: int) -> np.ndarray:
        """Squared distance along each line's own direction: n positions from ``first`` by the lines' marked positions, inside and the nearest ones beyond."""
        out = np.empty((n, len(inside)))
        for k, marks in enumerate(inside):
            known = np.concatenate([before[k : k + 1], np.sort(marks), after[k : k + 1]]).astype(np.float64)
            known = known[~np.isnan(known)]
            at = np.arange(first, first + n)
            place = np.searchsorted(known, at)
            low, high = np.abs(at - known[np.maximum(place - 1, 0)]), np.abs(known[np.minimum(place, len(known) - 1)] - at)
            out[:, k] = np.minimum(low, high)
        return out * out

    def lower_envelope(v: np.ndarray, at: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """min over k of v[row, k] + (w - at[k]) ** 2 for each row and each w of ``wanted`` (rising).

        The parabola that is lowest at w moves rightwards with w, so the middle w of a stretch bounds the choices of both halves:
        each level of halving looks at every parabola about once a row, for all rows at a time.
        """
        rows, m = v.shape[0], len(wanted)
        choice = np.zeros((rows, m + 2), np.int64)
        choice[:, m + 1] = len(at) - 1
        step = 1
        while step < m + 1:
            step *= 2
        done = [0, m + 1]
        while step > 1:
            step //= 2
            middle = [p for p in range(step, m + 1, 2 * step)]
            known = np.array(done)
            left = known[np.searchsorted(known, middle) - 1]
            right = known[np.searchsorted(known, middle)]
            low, high = choice[:, left].ravel(), choice[:, right].ravel()  # rows by positions
            n = high - low + 1
            begin = np.concatenate([[0], np.cumsum(n)[:-1]])
            k = np.repeat(low - begin, n) + np.arange(n.sum())
            row = np.repeat(np.repeat(np.arange(rows), len(middle)), n)
            w = np.repeat(np.tile(wanted[np.array(middle) - 1], rows), n)
            cost = v[row, k] + (w - at[k]) ** 2
            best = np.minimum.reduceat(cost, begin)
            hit = np.flatnonzero(cost == np.repeat(best, n))
            first = hit[np.searchsorted(hit, begin)]
            choice[:, middle] = k[first].reshape(rows, -1)
            done = sorted({*done, *middle})
        k = choice[:, 1 : m + 1]
        return np.take_along_axis(v, k, axis=1) + (wanted - at[k]) ** 2

    def solve(key, pixels: pd.DataFrame, lines: pd.DataFrame) -> pd.DataFrame:
        if not len(pixels):
            return pixels.assign(d2=0.0)[["u", "v", "d2"]]
        if not len(lines):
            return pixels.assign(d2=np.nan)[["u", "v", "d2"]]
        lines = lines.sort_values("v")
        first = int(key[0]) * size
        u = np.unique(pixels["u"].to_numpy())
        wanted = np.unique(pixels["v"].to_numpy())
        marks = [np.asarray([] if x is None else x, np.float64) for x in lines["inside"]]
        along = nearest(marks, lines["before"].to_numpy(np.float64), lines["after"].to_numpy(np.float64), first, size)[u - first]
        d2 = lower_envelope(along, lines["v"].to_numpy(np.float64), wanted.astype(np.float64))
        return pixels.assign(d2=d2[np.searchsorted(u, pixels["u"]), np.searchsorted(wanted, pixels["v"])])[["u", "v", "d2"]]

    return solve


def distance_transform(pixels: DataFrame, marked: DataFrame, cell: float) -> DataFrame:
    """``row, col, d``: the exact distance of each pixel to the nearest marked one, however far; null where none is marked.

    The grid is cut into strips across its longer side. Along it, each line of pixels passes the nearest marked pixels before
    and after each strip on (one row a line and strip); within a strip the nearest one along every line is known then, and the lower envelope of
    the parabolas that these distances make gives the exact minimum across. A task holds a strip: ``STRIP`` pixels, or one line of the shorter side.
    """
    box = pixels.agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1")).first()
    if box.r0 is None or marked.isEmpty():
        return pixels.select("row", "col", F.lit(None).cast("double").alias("d"))
    long, short = ("row", "col") if box.r1 - box.r0 >= box.c1 - box.c0 else ("col", "row")
    across = min(box.r1 - box.r0, box.c1 - box.c0) + 1
    size = max(1, min(STRIP // across, max(box.r1 - box.r0, box.c1 - box.c0) + 1))
    low, high = (box.r0, box.r1) if long == "row" else (box.c0, box.c1)
    strip = F.floor(F.col("u") / size).cast("int")
    each = marked.select(F.col(long).alias("u"), F.col(short).alias("v")).distinct().groupBy("v", strip.alias("strip")).agg(
        F.collect_list("u").alias("inside"), F.min("u").alias("first"), F.max("u").alias("last"))  # at most ``size`` marks
    w = Window.partitionBy("v").orderBy("strip")
    each = each.withColumns({"last_before": F.lag("last").over(w), "strip_before": F.lag("strip").over(w), "first_after": F.lead("first").over(w)})
    ends = (low // size, high // size)
    # A strip without marks on a line takes the nearest ones of the strips around: the row of the next marked strip covers the gap before it.
    begin = F.greatest(F.coalesce(F.col("strip_before") + 1, F.lit(ends[0])), F.lit(ends[0]))
    covered = F.when(begin <= F.least(F.col("strip"), F.lit(ends[1])), F.sequence(begin, F.least(F.col("strip"), F.lit(ends[1]))))
    own = each.select("v", "strip", "inside", "first", "first_after", "last_before", F.explode(covered).alias("at"))
    here = F.col("at") == F.col("strip")
    lines = own.select("v", F.col("at").alias("strip"), F.when(here, F.col("inside")).alias("inside"), F.col("last_before").alias("before"), F.when(here, F.col("first_after")).otherwise(F.col("first")).alias("after"))
    tail = each.where(F.col("first_after").isNull() & (F.col("strip") < ends[1])).select("v", F.explode(F.sequence(F.greatest(F.col("strip") + 1, F.lit(ends[0])), F.lit(ends[1]))).alias("strip"), F.lit(None).cast("array<int>").alias("inside"), F.col("last").alias("before"), F.lit(None).cast("int").alias("after"))
    dealt = pixels.select(F.col(long).alias("u"), F.col(short).alias("v")).withColumn("strip", strip)
    lines = lines.select("v", "strip", F.col("inside").cast("array<int>").alias("inside"), F.col("before").cast("double").alias("before"), F.col("after").cast("double").alias("after")).union(
        tail.select("v", "strip", "inside", F.col("before").cast("double"), F.col("after").cast("double")))
    found = dealt.groupBy("strip").cogroup(lines.groupBy("strip")).applyInPandas(_strip_solver(size), "u int, v int, d2 double")
    return found.select(F.col("u").alias(long), F.col("v").alias(short), (F.sqrt("d2") * cell).alias("d")).select("row", "col", "d")


def point_distance(pixels: DataFrame, points: DataFrame, grid: Grid, reach: float = 1000.0) -> DataFrame:
    """``row, col, d``: distance of each pixel's centre to the nearest point (x, y) within reach, else null. Points may lie off the grid.

    Points and pixels meet in cells of the size of the reach, points in the nine cells around them. A cell keeps of each of its pixels the nearest point.
    """
    at = lambda v: F.floor(F.col(v) / reach)
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    dealt = points.select(F.col("x").alias("px"), F.col("y").alias("py")).distinct().withColumns({"cx": F.floor(F.col("px") / reach), "cy": F.floor(F.col("py") / reach)})
    dealt = dealt.withColumn("o", F.explode(around)).select("px", "py", (F.col("cx") + F.col("o.i")).alias("cx"), (F.col("cy") + F.col("o.j")).alias("cy"))
    x, y = grid.centre()
    own = pixels.select("row", "col", x.alias("x"), y.alias("y")).withColumns({"cx": at("x"), "cy": at("y")})
    d = F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py"))
    near = own.join(spread(dealt), ["cx", "cy"]).select("row", "col", d.alias("d")).where(F.col("d") <= reach).groupBy("row", "col").agg(F.min("d").alias("d"))
    return pixels.select("row", "col").join(spread(near), ["row", "col"], "left")
