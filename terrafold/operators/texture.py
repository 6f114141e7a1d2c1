"""Texture of image windows (window, row, col, value): edges, Laplacian, opening by a disk, components, and the signature of a patch.

A window has at most side * side pixels; rows and columns begin at 0. Convolutions go along columns and then along rows, and repeat the border pixel beyond it.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrafold.operators.raster import patches
from terrafold.operators.review import patch_pattern
from terrafold.operators.zones import swept
from terrafold.sources.tables import spread

#: Edges are steeper than so many times the upper quartile of their window.
STEEP = 1.25


def _around(v: str | Column, w) -> tuple[Column, Column]:
    """The values before and after, at the border the value itself."""
    v = F.col(v) if isinstance(v, str) else v
    return F.coalesce(F.lag(v).over(w), v), F.coalesce(F.lead(v).over(w), v)


def gradients(pixels: DataFrame, value: str) -> DataFrame:
    """``window, row, col, magnitude, laplacian``: the Sobel operator (both axes) and the second differences of both axes."""
    down, across = Window.partitionBy("window", "col").orderBy("row"), Window.partitionBy("window", "row").orderBy("col")
    above, below = _around(value, down)
    first = pixels.select("window", "row", "col", F.col(value).alias("v"), (below - above).alias("d"), (above + 2 * F.col(value) + below).alias("s"), (above + below - 2 * F.col(value)).alias("dd"))
    left, right = _around("v", across)
    d0, d1 = _around("d", across)
    s0, s1 = _around("s", across)
    return first.select("window", "row", "col", F.hypot(d0 + 2 * F.col("d") + d1, s1 - s0).alias("magnitude"), (F.col("dd") + left + right - 2 * F.col("v")).alias("laplacian"))


def edge_measures(pixels: DataFrame, value: str) -> DataFrame:
    """``window, edge_density, laplacian_var``: share of pixels steeper than ``STEEP`` upper quartiles, and the variance of the Laplacian."""
    g = gradients(pixels, value)
    limits = g.groupBy("window").agg((F.percentile("magnitude", F.lit(0.75)) * STEEP).alias("limit"), F.var_pop("laplacian").alias("laplacian_var"))
    return g.join(spread(limits), "window").groupBy("window").agg(F.avg((F.col("magnitude") > F.col("limit")).cast("double")).alias("edge_density"), F.first("laplacian_var").alias("laplacian_var"))


def mask_runs(mask: DataFrame) -> DataFrame:
    """Runs (window, row, col_from, col_to) of flagged pixels (window, row, col)."""
    one = mask.select("window", "row", F.col("col").alias("col_from"), F.col("col").alias("col_to"))
    return swept(one, 1, ("window",))


def opened(runs: DataFrame, side: int, radius: int) -> DataFrame:
    """The runs opened by a disk: what is left where the disk fits, and everything that the disk covers there. Pixels beyond the window fit.

    A disk is a stack of segments, one a row. Eroding is the sweep of as many shifted and shortened copies of the runs as the disk
    has rows, all of which must hold; dilating is that of shifted and lengthened copies, one of which must.
    """
    stack = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(isqrt(radius * radius - dr * dr)).alias("half")) for dr in range(-radius, radius + 1)])
    images = runs.select("window").distinct()
    beyond = images.select("window", F.explode(F.array(*[F.lit(r) for r in [*range(-radius, 0), *range(side, side + radius)]])).alias("row"), F.lit(0).alias("col_from"), F.lit(side - 1).alias("col_to"))
    far = side + radius  # a run at the border goes on beyond it
    wide = runs.select("window", "row", F.when(F.col("col_from") == 0, F.lit(-far)).otherwise(F.col("col_from")).alias("col_from"), F.when(F.col("col_to") == side - 1, F.lit(2 * far)).otherwise(F.col("col_to")).alias("col_to"))
    wide = wide.union(beyond.select("window", "row", F.lit(-far).alias("col_from"), F.lit(2 * far).alias("col_to")))
    shorter = wide.select("window", "col_from", "col_to", F.col("row").alias("r"), F.inline(stack)).select("window", (F.col("r") + F.col("dr")).alias("row"), (F.col("col_from") + F.col("half")).alias("col_from"), (F.col("col_to") - F.col("half")).alias("col_to"))
    kept = swept(shorter.where("col_from <= col_to"), 2 * radius + 1, ("window",)).where((F.col("row") >= 0) & (F.col("row") < side))
    kept = kept.select("window", "row", F.greatest("col_from", F.lit(0)).alias("col_from"), F.least("col_to", F.lit(side - 1)).alias("col_to")).where("col_from <= col_to")
    longer = kept.select("window", "col_from", "col_to", F.col("row").alias("r"), F.inline(stack)).select("window", (F.col("r") + F.col("dr")).alias("row"), F.greatest(F.col("col_from") - F.col("half"), F.lit(0)).alias("col_from"), F.least(F.col("col_to") + F.col("half"), F.lit(side - 1)).alias("col_to"))
    return swept(longer.where((F.col("row") >= 0) & (F.col("row") < side)), 1, ("window",))


def patch_measures(mask: DataFrame, windows: DataFrame, side: int, radius: int = 5, least_green: float = 0.02) -> DataFrame:
    """For each window: ``green`` (share of flagged pixels), ``n_patches, mean_patch, largest`` (of its components), ``opened`` (share that
    an opening leaves) and ``pattern``; zeros below ``least_green``. ``mask``: window, row, col of flagged pixels; ``windows``: window, n (pixels)."""
    runs = mask_runs(mask)
    flagged = mask.groupBy("window").agg(F.count(F.lit(1)).alias("flagged"))
    left = opened(runs, side, radius).groupBy("window").agg(F.sum(F.col("col_to") - F.col("col_from") + 1).alias("left"))
    parts = patches(mask, 1, ("window",)).groupBy("window", "patch").agg(F.count(F.lit(1)).alias("n")).groupBy("window").agg(F.count(F.lit(1)).alias("n_patches"), F.avg("n").alias("mean_patch"), F.max("n").alias("most"))
    met = windows.join(spread(flagged), "window", "left").join(spread(left), "window", "left").join(spread(parts), "window", "left")
    green = F.coalesce("flagged", F.lit(0)) / F.col("n")
    some = lambda v: F.when(F.col("green") >= least_green, F.coalesce(v, F.lit(0.0))).otherwise(F.lit(0.0))
    out = met.withColumn("green", green).select("window", "green", some(F.col("n_patches").cast("double")).cast("long").alias("n_patches"), some(F.col("mean_patch")).alias("mean_patch"), some(F.col("most") / F.col("flagged")).alias("largest"), some(F.col("left") / F.col("flagged")).alias("opened"))
    return out.withColumn("pattern", patch_pattern(F.col("green"), F.col("n_patches"), F.col("mean_patch"), F.col("largest"), F.col("opened")))
