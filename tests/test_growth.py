"""What grows with the tables is neither sent whole through the driver nor walked one step a round."""

import math

from pyspark.sql import functions as F

from terrafold.functions import geo
from terrafold.operators import hydrology, mapping, raster, resampling, spatial, texture
from terrafold.operators.zones import Grid
from terrafold.plans import maps, studies, views


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_buffers_of_points_are_not_broadcast(spark):
    points = spark.range(5).select(F.col("id").alias("from_id"), (F.col("id") * 10.0).alias("x"), F.lit(-15.0).alias("y"))
    pixels = raster.grid_pixels(spark, 4, 6).withColumn("v", F.col("col").cast("double"))
    found = spatial.buffer_mean(points, pixels, Grid(0.0, 0.0, 10.0), 12.0, "v")
    assert "Broadcast" not in plan(found)
    assert {r.from_id: (r.mean, r.n_valid) for r in found.collect()}[2] == (1.5, 6)


def test_patches_across_blocks(spark):
    lines = ["##..#...#", "..#.#.#..", "#..#...#.", "#......#.", ".#.#.#...", "..#.#..##"]
    flagged = [(r - 2, c, k) for k in (0, 1) for r, line in enumerate(lines) for c, x in enumerate(line if k == 0 else line[::-1]) if x == "#"]

    def flood(at):
        parts, left = {}, set(at)
        while left:
            queue = [min(left)]
            first, got = queue[0], set()
            while queue:
                p = queue.pop()
                if p in left:
                    left.discard(p)
                    got.add(p)
                    queue += [(p[0] + i, p[1] + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
            parts |= {p: (first, len(got)) for p in got}
        return parts

    px = spark.createDataFrame(flagged, "row int, col int, image int")
    one = raster.patches(px.where("image = 0").select("row", "col"), 1, block=3)
    assert "Broadcast" not in plan(one)
    want = flood([(r, c) for r, c, k in flagged if k == 0])
    assert {(r.row, r.col): (r.patch, r.size) for r in one.collect()} == {p: (a[0] * (1 << 31) + a[1], n) for p, (a, n) in want.items()}
    both = {(r.image, r.row, r.col): (tuple(r.patch), r.size) for r in raster.patches(px, 1, ("image",), block=2).collect()}
    assert both == {(k, *p): ((k, *a), n) for k in (0, 1) for p, (a, n) in flood([(r, c) for r, c, i in flagged if i == k]).items()}
    assert raster.patches(px.where("row > 99").select("row", "col")).count() == 0


def test_measures_of_patches_are_not_broadcast(spark):
    mask = spark.range(40).select((F.col("id") / 20).cast("long").alias("window"), (F.col("id") % 20 / 5).cast("int").alias("row"), (F.col("id") % 5).cast("int").alias("col"))
    found = texture.patch_measures(mask.where("row <> 1"), mask.groupBy("window").agg(F.count(F.lit(1)).alias("n")), 5, 1)
    assert "Broadcast" not in plan(found)
    assert [(r.window, r.n_patches, r.mean_patch) for r in found.orderBy("window").collect()] == [(0, 2, 7.5), (1, 2, 7.5)]


def test_flow_across_blocks(spark):
    height = lambda r, c: ((r * 37 + c * 101 + r * c * 13) % 50) - 3.0 * r - abs(c - 6)
    z = {(r, c): height(r, c) for r in range(-3, 17) for c in range(14) if (r, c) != (5, 9)}
    dem = spark.createDataFrame([(r, c, v) for (r, c), v in z.items()], "row int, col int, z double")
    around = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]

    def below(r, c):
        near = [(i, j) for i, j in around if (r + i, c + j) in z]
        drops = [(round((z[r, c] - z[r + i, c + j]) / (10 * (2**0.5 if i and j else 1)), 9), -i, -j) for i, j in near]
        drop, i, j = max(drops)
        return (r - i, c - j) if len(near) == 8 and drop > 0 else None

    to = {p: below(*p) for p in z}
    n = dict.fromkeys(z, 0)
    for p in z:
        while p:
            n[p], p = n[p] + 1, to[p]
    for block in (3, 5, 256):
        flow = hydrology.receivers(dem, 10.0, block)
        assert "Join" not in plan(flow)  # a cell meets its neighbours within its block
        assert {(r.row, r.col): r.to_row is not None and (r.to_row, r.to_col) or None for r in flow.collect()} == to
        assert {(r.row, r.col): round(r.hectares * 100) for r in hydrology.accumulation(flow, 10.0, block).collect()} == n


def test_texts_of_low_ground_are_null_as_in_sql(spark, monkeypatch):
    low = spark.createDataFrame([(0, 0, 100.0, 0.5), (1, 0, 99.0, 0.25), (2, 0, -250.0, 0.1)], "row int, col int, z double, value double")
    monkeypatch.setattr(views, "pixels", lambda spark, sf_dir: low)
    assert [(r.text, r.z, r.small) for r in maps.number_texts(spark, "").orderBy("row").collect()] == [("0.5000", "100", "0.250"), ("0.2500", None, "0.125"), ("0.1000", None, "0.050")]


def test_view_of_a_high_grid_keeps_its_zoom(spark, monkeypatch):
    high = 40_000
    monkeypatch.setattr(views, "pixels", lambda spark, sf_dir: spark.createDataFrame([(0, 0, 1), (high - 1, 3, 2)], "row int, col int, code int"))
    res = resampling.METRES_AT_ZOOM_0 / 2**14
    place = lambda lat: math.log(math.tan(math.radians(lat) / 2 + math.pi / 4)) * geo.A / res
    wide = math.ceil(math.radians(studies.VIEW_WEST + studies.VIEW_WIDTH) * geo.A / res) - math.floor(math.radians(studies.VIEW_WEST) * geo.A / res)
    n = wide * (math.ceil(place(studies.VIEW_NORTH)) - math.floor(place(studies.VIEW_NORTH - high / 11000)))
    assert n > resampling.MOST_POINTS and studies.map_view(spark, "").count() == n


def test_spaced_points_of_many_tiles_and_copies(spark):
    at = {k: ((k % 24) * 0.7, (k // 24 % 20) * 0.6) for k in range(1200)}  # rows of places, most of them more than once
    points = spark.createDataFrame([(k, *xy) for k, xy in at.items()] + [(9001, None, 1.0), (9002, None, 1.0)], "id long, x double, y double")
    kept = []
    for k, xy in at.items():
        if all(math.dist(xy, at[o]) >= 1.5 for o in kept):
            kept.append(k)
    for cells in (2, 16):
        assert sorted(r.id for r in spatial.spaced(points, 1.5, cells).collect()) == [*kept, 9001, 9002]


def test_classes_add_probabilities_once(spark):
    px = spark.createDataFrame([(0, [0.1, 0.4, 0.5]), (1, [0.7, 0.2, 0.1])], "id int, p array<double>").repartition(2)
    done = mapping.classify(px, [], F.col("p"), threshold=0.6)
    assert done._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 1
    assert [(r.code, round(r.p_max, 6), round(r.p_meadow, 6)) for r in done.orderBy("id").collect()] == [(2, 0.5, 0.9), (0, 0.7, 0.3)]
