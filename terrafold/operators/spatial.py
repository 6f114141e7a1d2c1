"""Joins and filters by distance and area, on projected coordinates x and y."""

from __future__ import annotations

from math import floor, hypot

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrafold.sources.tables import spread


def _cells(size: float, reach: int = 0) -> list[Column]:
    cx, cy = F.floor(F.col("x") / size), F.floor(F.col("y") / size)
    if not reach:
        return [cx.alias("cx"), cy.alias("cy")]
    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)])
    return [F.inline(F.transform(offsets, lambda o: F.struct((cx + o["i"]).alias("cx"), (cy + o["j"]).alias("cy"))))]


def pairs_within(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """``from_id, to_id, d`` of all pairs within the radius.

    Cells have the radius as their size: the left rows go to the nine cells around them, the join is on the cell. No
    side is broadcast and no pair beyond neighbouring cells is made.
    """
    a = left.select("from_id", F.col("x").alias("ax"), F.col("y").alias("ay"), "x", "y").select("from_id", "ax", "ay", *_cells(radius, 1))
    b = right.select("to_id", F.col("x").alias("bx"), F.col("y").alias("by"), *_cells(radius))
    d = F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by"))
    return spread(a).join(b, ["cx", "cy"]).select("from_id", "to_id", d.alias("d")).where(F.col("d") <= radius)


def nearest_within(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """The nearest right row of each left row within the radius; the smallest id of equals."""
    best = pairs_within(left, right, radius).groupBy("from_id").agg(F.min(F.struct("d", "to_id")).alias("m"))
    return best.select("from_id", F.col("m.to_id").alias("to_id"), F.col("m.d").alias("d"))


def nearest_distance(rows: DataFrame, layer: DataFrame, cell: float, factor: int = 4) -> DataFrame:
    """``from_id, d`` to the nearest point of the layer, at any distance.

    The layer's occupied cells form a tree: cells of size ``cell`` in cells ``factor`` times as large, up to a few. Each
    row starts at the top and goes down level by level into the cells that may hold its nearest point, which are those no
    farther than the least distance within which some cell has a point for certain. Every level is one join on the cell.
    """
    rows, places = rows.select("from_id", "x", "y"), layer.select(F.col("x").alias("bx"), F.col("y").alias("by")).distinct()
    box = places.agg(F.min("bx"), F.max("bx"), F.min("by"), F.max("by")).first()
    if box[0] is None:
        return rows.select("from_id", F.lit(None).cast("double").alias("d"))
    top = 0
    while max(box[1] - box[0], box[3] - box[2]) / (cell * factor**top) > factor:
        top += 1
    places = places.withColumns({"cx": F.floor(F.col("bx") / cell), "cy": F.floor(F.col("by") / cell)})
    up = lambda c, n: F.floor(F.col(c) / factor**n)
    levels = [places.select(up("cx", k).alias("cx"), up("cy", k).alias("cy")).distinct() for k in range(top + 1)]
    roots = [(r.cx, r.cy) for r in levels[top].collect()]  # at most (factor + 2) ** 2 cells
    open_ = rows.withColumn("cell", F.explode(F.array(*[F.struct(F.lit(a).alias("cx"), F.lit(b).alias("cy")) for a, b in roots]))).select("from_id", "x", "y", "cell.cx", "cell.cy")
    for k in range(top, -1, -1):
        size = cell * factor**k
        out = lambda p, c, s=size: F.greatest(F.col(c) * s - F.col(p), F.col(p) - (F.col(c) + 1) * s, F.lit(0.0))
        far = lambda p, c, s=size: F.greatest(F.abs(F.col(p) - F.col(c) * s), F.abs(F.col(p) - (F.col(c) + 1) * s))
        sure = F.min(F.hypot(far("x", "cx"), far("y", "cy"))).over(Window.partitionBy("from_id"))  # the cells of one row
        open_ = open_.withColumns({"least_": F.hypot(out("x", "cx"), out("y", "cy")), "sure": sure}).where(F.col("least_") <= F.col("sure") * (1 + 1e-9)).drop("least_", "sure")
        if k:
            below = levels[k - 1].select((up("cx", 1)).alias("px"), (up("cy", 1)).alias("py"), F.col("cx").alias("nx"), F.col("cy").alias("ny"))
            open_ = open_.join(below, (F.col("cx") == F.col("px")) & (F.col("cy") == F.col("py"))).select("from_id", "x", "y", F.col("nx").alias("cx"), F.col("ny").alias("cy"))
    d = F.hypot(F.col("x") - F.col("bx"), F.col("y") - F.col("by"))
    return open_.join(places, ["cx", "cy"]).groupBy("from_id").agg(F.min(d).alias("d"))


def far_from(rows: DataFrame, layer: DataFrame, least: float, strictly: bool = False) -> DataFrame:
    """Rows without a point of the layer nearer than ``least``; strictly: nor at that distance."""
    d = F.col("d")
    near = pairs_within(rows.select("from_id", "x", "y"), layer, least).where(d <= least if strictly else d < least)
    return rows.join(spread(near.select("from_id").distinct()), "from_id", "left_anti")


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point to a segment."""
    dx, dy = bx - ax, by - ay
    t = F.coalesce(F.try_divide((px - ax) * dx + (py - ay) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    return F.hypot(px - (ax + t * dx), py - (ay + t * dy))


def inside_polygons(points: DataFrame, edges: DataFrame, cell: float) -> DataFrame:
    """``from_id`` of the points in any polygon, borders included.

    ``edges`` has polygon, ax, ay, bx, by. Each edge goes to the rows of cells that it spans, so a point meets only
    edges of its own row of cells; a point is inside if an odd number of a polygon's edges lies to its right.
    """
    spans = F.sequence(F.floor(F.least("ay", "by") / cell), F.floor(F.greatest("ay", "by") / cell))
    rows = edges.withColumn("cy", F.explode(spans))
    met = points.withColumn("cy", F.floor(F.col("y") / cell)).join(rows, "cy")
    crosses = (F.col("ay") > F.col("y")) != (F.col("by") > F.col("y"))
    at = F.when(crosses, F.col("ax") + (F.col("y") - F.col("ay")) * (F.col("bx") - F.col("ax")) / (F.col("by") - F.col("ay")))
    on = segment_distance(F.col("x"), F.col("y"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")) < 1e-9
    each = met.groupBy("from_id", "polygon").agg(F.count_if(crosses & (at > F.col("x"))).alias("n"), F.max(on).alias("on"))
    return each.where((F.col("n") % 2 == 1) | F.col("on")).select("from_id").distinct()


def cell_lookup(points: DataFrame, pixels: DataFrame) -> DataFrame:
    """Each point with the pixel of its row and column; points outside keep nulls."""
    return points.join(pixels, ["row", "col"], "left")


def neighbourhood(points: DataFrame, pixels: DataFrame, reach: int, value: str) -> DataFrame:
    """Mean and count of the valid pixels in the square window around each point."""
    span = F.sequence(F.lit(-reach), F.lit(reach))
    keys = points.withColumn("dr", F.explode(span)).withColumn("dc", F.explode(span)).select("from_id", (F.col("row") + F.col("dr")).alias("row"), (F.col("col") + F.col("dc")).alias("col"))
    return spread(keys).join(pixels, ["row", "col"], "left").groupBy("from_id").agg(F.avg(value).alias("mean"), F.count(value).alias("n_valid"))


def buffer_mean(points: DataFrame, pixels: DataFrame, grid, radius: float, value: str) -> DataFrame:
    """``from_id, mean, n_valid`` of the pixels whose centre lies within the radius of each point (from_id, x, y).

    Pixels count whole by their centre; a service that weighs border pixels by their covered share differs there.
    """
    from math import ceil

    reach = ceil(radius / grid.cell)
    span = F.array(*[F.struct(F.lit(i).alias("dr"), F.lit(j).alias("dc")) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)])
    at = points.select("from_id", "x", "y", F.explode(span).alias("o")).select(
        "from_id", "x", "y", (F.floor((grid.y0 - F.col("y")) / grid.cell) + F.col("o.dr")).cast("int").alias("row"), (F.floor((F.col("x") - grid.x0) / grid.cell) + F.col("o.dc")).cast("int").alias("col"))
    cx, cy = grid.centre()
    near = at.where(F.hypot(cx - F.col("x"), cy - F.col("y")) <= radius)
    found = spread(near).join(pixels.select("row", "col", value), ["row", "col"]).groupBy("from_id").agg(F.avg(value).alias("mean"), F.count(value).alias("n_valid"))
    return points.select("from_id").join(spread(found), "from_id", "left").select("from_id", "mean", F.coalesce("n_valid", F.lit(0)).alias("n_valid"))


def at_place(rows: DataFrame, values: DataFrame, lon: str = "lon", lat: str = "lat", digits: int = 7) -> DataFrame:
    """``rows`` with the values that were read at the same place, to so many decimals of a degree; of places read twice the values of
    the first by all their columns. Rows without a reading keep nulls."""
    key = lambda c, name: F.bround(F.col(c) * 10**digits).cast("long").alias(name)
    own = [c for c in values.columns if c not in (lon, lat)]
    read = values.select(key(lon, "lon_"), key(lat, "lat_"), F.struct(*own).alias("v_")).groupBy("lon_", "lat_").agg(F.min("v_").alias("v_"))
    met = rows.withColumns({"lon_": key(lon, "l"), "lat_": key(lat, "l")}).join(read, ["lon_", "lat_"], "left")
    return met.select(*rows.columns, *[F.col(f"v_.{c}").alias(c) for c in own])


def degree_area_km2(edges: DataFrame) -> DataFrame:
    """``polygon, km2`` of polygons in degrees: 12321 square kilometres a square degree, at any latitude."""
    return edges.groupBy("polygon").agg((F.abs(F.sum(F.col("ax") * F.col("by") - F.col("bx") * F.col("ay"))) / 2 * 12321).alias("km2"))


def occupied_cells(points: DataFrame, size_x: float, size_y: float, area: float) -> DataFrame:
    """Number of cells with points, and their area."""
    return points.select(F.floor(F.col("x") / size_x).alias("cx"), F.floor(F.col("y") / size_y).alias("cy")).distinct().agg(
        F.count(F.lit(1)).alias("cells"), (F.count(F.lit(1)) * area).alias("area"))


def bounding_box(points: DataFrame, buffer: float) -> DataFrame:
    return points.agg((F.min("x") - buffer).alias("min_x"), (F.min("y") - buffer).alias("min_y"), (F.max("x") + buffer).alias("max_x"), (F.max("y") + buffer).alias("max_y"))


def first_region(points: DataFrame, regions: DataFrame) -> DataFrame:
    """The first region, by priority, whose box holds each point. ``regions`` is a short list and is broadcast."""
    if regions.count() > 10_000:
        raise ValueError("too many regions to broadcast")
    r = F.broadcast(regions)
    held = points.join(r, (points["x"] >= r["min_x"]) & (points["x"] <= r["max_x"]) & (points["y"] >= r["min_y"]) & (points["y"] <= r["max_y"]), "left")
    return held.groupBy("from_id").agg(F.min_by("region", "priority").alias("region"))


def uniform_in_box(spark, n: int, box: tuple[float, float, float, float], seed: int, start: int = 0) -> DataFrame:
    """n points, uniform in a box, the same for the same seed (by MD5 of seed, axis and number); numbered from ``start``."""
    digits = lambda k: F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(k)), F.col("id").cast("string")).cast("binary")), 1, 13)
    u = lambda k: (F.conv(digits(k), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return spark.range(start, start + n).select("id", (box[0] + u(1) * (box[2] - box[0])).alias("x"), (box[1] + u(2) * (box[3] - box[1])).alias("y"))


def uniform_in_area(edges: DataFrame, n: int, seed: int = 42, most_tries: int = 200) -> tuple[DataFrame, int]:
    """n points (id, x, y), uniform in polygons (borders included), and how many were tried: at most ``most_tries`` times n.

    The tries of a seed are numbered, so the points are the first n inside, whatever the batches: reruns agree. Batches grow with what
    the share inside so far says that it takes; an area that holds almost nothing ends with fewer points.
    """
    from terrafold.sources.tables import saved

    spark = edges.sparkSession
    box = edges.agg(F.min(F.least("ax", "bx")), F.min(F.least("ay", "by")), F.max(F.greatest("ax", "bx")), F.max(F.greatest("ay", "by"))).first()
    empty = spark.createDataFrame([], "id long, x double, y double")
    if box[0] is None or n < 1:
        return empty, 0
    cell = max(box[3] - box[1], 1e-9) / 256
    found, held, tried, limit = empty, 0, 0, n * most_tries
    while held < n and tried < limit:
        more = min(limit - tried, max(n, int((n - held) * 1.2 * (tried + 1) / (held + 1))))
        batch = uniform_in_box(spark, more, tuple(box), seed, tried)
        inside = inside_polygons(batch.select(F.col("id").alias("from_id"), "x", "y"), edges, cell)
        found = saved(found.union(batch.join(inside, batch["id"] == inside["from_id"], "left_semi")), "points-inside")
        held, tried = found.count(), tried + more
    return (found.orderBy("id").limit(n) if held > n else found), tried


def random_points(edges: DataFrame, n: int, elevation=None, low: float | None = None, high: float | None = None, stratified: bool = False, avoid: DataFrame | None = None, far: float = 0.0, seed: int = 42) -> tuple[DataFrame, dict]:
    """Up to n points (id, x, y and z, if elevations are asked for) in an area, away from the points ``avoid`` (x, y), within a range of elevation or from five bands of it.

    ``elevation`` takes points (id, x, y) and gives them z. The second result says what was kept, and why nothing was: ``low above area``,
    ``high below area``, ``nothing in range`` or ``no elevations``.
    """
    from terrafold.operators.samples import within_range

    ranged, away = bool(low or high), avoid is not None and far > 0
    pool, tried = uniform_in_area(edges, n * (4 if stratified else 3 if ranged else 1) * (3 if away else 1), seed)
    about = {"requested": n, "tried": tried, "excluded": 0, "reason": None}
    if away:
        kept = far_from(pool.withColumnRenamed("id", "from_id"), avoid.select("x", "y").withColumn("to_id", F.lit(0)), far).withColumnRenamed("from_id", "id").select("id", "x", "y")
        about["excluded"] = pool.count() - kept.count()
        pool = kept
    if ranged or stratified:
        if elevation is None:
            raise ValueError("elevations are needed for a range or bands of them")
        pool = elevation(pool).where("z is not null")
        ends = pool.agg(F.min("z").alias("a"), F.max("z").alias("b")).first()
        about |= {"lowest": ends.a, "highest": ends.b}
        pool = within_range(pool, "z", low, high)
        if pool.isEmpty():
            about["reason"] = "no elevations" if ends.a is None else "low above area" if low and ends.b < low else "high below area" if high and ends.a > high else "nothing in range"
        elif stratified:
            pool = bands(pool, "z", 5, max(1, n // 5), ["id"]).drop("band")
    out = pool.orderBy("id").limit(n)
    return out, {**about, "kept": out.count()}


def _tile_thinner(least: float):
    """A function that decides which of one tile's points stay, first ids first, as far as the points around the tile allow.

    It is made here, not at the top of the module, so that it travels to workers whole.
    """
    def thin(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id", ignore_index=True)
        kept, open_ = {}, {}
        stays = []
        for x, y, known, own in zip(rows["x"], rows["y"], rows["kept"], rows["own"]):
            cx, cy = floor(x / least), floor(y / least)
            near = lambda places: any(hypot(x - a, y - b) < least for i in (-1, 0, 1) for j in (-1, 0, 1) for a, b in places.get((cx + i, cy + j), ()))  # noqa: B023, E731
            goes = not known and near(kept)
            if not known and not goes and own:
                known = not near(open_)
            if not goes:
                (kept if known else open_).setdefault((cx, cy), []).append((x, y))
            stays.append(None if goes else bool(known))
        return rows.assign(kept=pd.Series(stays, dtype="boolean"))[rows["own"] & ~pd.Series([k is None for k in stays], dtype=bool)][["id", "x", "y", "kept"]]

    return thin


def spaced(points: DataFrame, least: float, cells: int = 16) -> DataFrame:
    """A subset in which no two points are nearer than ``least`` and to which none can be added: points that come first (by id) among their remaining
    neighbours stay, and their neighbours go.

    Tiles of ``cells`` times ``least`` a side are thinned for themselves, with the points around them; a point whose earlier neighbours are open stays open
    until the next round, whose tiles lie half a tile aside. Of points at one place only the first can stay, so the others don't take part.
    """
    from terrafold.sources.tables import saved

    rows, side = points.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), cells * least
    nowhere = F.col("x").isNull() | F.col("y").isNull() | F.isnan("x") | F.isnan("y")  # near to nothing
    if least <= 0:
        return rows
    state = saved(rows.where(~nowhere).groupBy("x", "y").agg(F.min("id").alias("id")).select("id", "x", "y", F.lit(False).alias("kept")), "spaced")
    shape, shift = f"id {rows.schema['id'].dataType.simpleString()}, x double, y double, kept boolean", 0.0
    while not state.where("not kept").isEmpty():
        at = lambda c, d=0.0, s=shift: F.floor((F.col(c) + d - s) / side)
        near = lambda c: F.array_distinct(F.array(at(c, -least), at(c), at(c, least)))
        dealt = state.withColumn("tx", F.explode(near("x"))).withColumn("ty", F.explode(near("y"))).withColumn("own", (F.col("tx") == at("x")) & (F.col("ty") == at("y")))
        state, shift = saved(dealt.groupBy("tx", "ty").applyInPandas(_tile_thinner(least), shape), "spaced"), side / 2 - shift
    return state.select("id", "x", "y").union(rows.where(nowhere))


def bands(rows: DataFrame, value: str, n: int, per_band: int, order: list[Column | str]) -> DataFrame:
    """Up to ``per_band`` rows of each of n equal bands of a value."""
    low, high = rows.agg(F.min(value), F.max(value)).first()
    if low is None:
        return rows.withColumn("band", F.lit(None).cast("int")).limit(0)
    band = F.least(F.floor((F.col(value) - low) * n / ((high - low) or 1.0)), F.lit(n - 1)).cast("int")
    ranked = rows.withColumn("band", band).withColumn("rank_", F.row_number().over(Window.partitionBy("band").orderBy(*order)))
    return ranked.where(F.col("rank_") <= per_band).drop("rank_")


def nearest_segment(points: DataFrame, segments: DataFrame, reach: float) -> DataFrame:
    """``from_id, d``: distance to the nearest segment within reach, else null.

    A segment goes to all cells of its box, widened by the reach, whose size is the reach; points to their own cell.
    """
    cells = lambda lo, hi: F.sequence(F.floor((lo - reach) / reach), F.floor((hi + reach) / reach))
    dealt = segments.withColumn("cx", F.explode(cells(F.least("ax", "bx"), F.greatest("ax", "bx")))).withColumn("cy", F.explode(cells(F.least("ay", "by"), F.greatest("ay", "by"))))
    met = points.select("from_id", "x", "y", *_cells(reach)).join(dealt, ["cx", "cy"], "left")
    d = segment_distance(F.col("x"), F.col("y"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    return met.groupBy("from_id").agg(F.min(F.when(d <= reach, d)).alias("d"))


def nearest_to(points: DataFrame, x: float, y: float, tolerance: float) -> DataFrame:
    """The point nearest to a place, if within the tolerance; the smallest id of equals."""
    d = F.hypot(F.col("x") - x, F.col("y") - y)
    return points.withColumn("d", d).where(F.col("d") <= tolerance).orderBy("d", "from_id").limit(1)
