"""Polygons as runs, zones to map, and exact distances, against plain geometry."""

import math
import random

import pytest
from pyspark.sql import functions as F

from terrafold.operators import raster, zones
from terrafold.operators.distance import distance_transform, point_distance
from terrafold.operators.zones import Grid

EDGES = "polygon int, ax double, ay double, bx double, by double"
GRID = Grid(100.0, 900.0, 10.0, 40, 50)


def rings_of(spark, rings):
    return zones.ring_edges(spark.createDataFrame([(p, r, i, float(x), float(y)) for (p, r), some in rings.items() for i, (x, y) in enumerate(some)], "polygon int, ring int, at int, x double, y double"))


def inside(x, y, rings):
    odd = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            if (ay > y) != (by > y) and ax + (y - ay) * (bx - ax) / (by - ay) > x:
                odd = not odd
    return odd


def pixels_of(runs):
    return {(r.row, c) for r in runs.collect() for c in range(r.col_from, r.col_to + 1)}


def star(cx, cy, size, n, seed):
    rng = random.Random(seed)
    return [(cx + size * rng.uniform(0.4, 1) * math.cos(2 * math.pi * k / n), cy + size * rng.uniform(0.4, 1) * math.sin(2 * math.pi * k / n)) for k in range(n)]


@pytest.fixture(scope="module")
def shapes():
    return {(1, 0): star(250, 700, 140, 9, 1), (1, 1): star(250, 700, 40, 5, 2), (2, 0): star(330, 640, 120, 7, 3), (3, 0): star(90, 500, 60, 6, 4), (4, 0): [(200, 400), (210, 400), (210, 410), (200, 410)]}


def test_runs_are_the_pixels_inside(spark, shapes):
    edges = rings_of(spark, shapes)
    centre = lambda r, c: (GRID.x0 + (c + 0.5) * 10, GRID.y0 - (r + 0.5) * 10)
    want = {(r, c) for r in range(50) for c in range(40) if any(inside(*centre(r, c), [ring for (q, _), ring in shapes.items() if q == p]) for p in (1, 2, 3, 4))}
    runs = zones.clipped(zones.zone_runs(edges, GRID), GRID)
    assert pixels_of(runs) == want and want
    rows = [r.asDict() for r in runs.collect()]
    assert sum(r["col_to"] - r["col_from"] + 1 for r in rows) == len(want)  # no overlap
    both = pixels_of(zones.intersection(zones.centre_runs(edges.where("polygon = 1"), GRID), zones.centre_runs(edges.where("polygon = 2"), GRID)))
    assert both == {p for p in want if all(inside(*centre(*p), [ring for (q, _), ring in shapes.items() if q == k]) for k in (1, 2))}
    assert zones.run_area(runs, 10.0).first().hectares == pytest.approx(len(want) / 100)
    flagged = zones.in_runs(raster.grid_pixels(spark, 50, 40), runs)
    assert {(r.row, r.col) for r in flagged.where("inside").collect()} == want and flagged.count() == 2000


def test_touched_pixels_hold_border_and_inside(spark, shapes):
    edges = rings_of(spark, {k: v for k, v in shapes.items() if k[0] in (1, 4)})
    got = pixels_of(zones.clipped(zones.touched_runs(edges, GRID), GRID))
    inner = pixels_of(zones.clipped(zones.zone_runs(edges, GRID), GRID))
    walked = set()
    for ring in (v for k, v in shapes.items() if k[0] == 1):
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            walked |= {(math.floor((900 - ay - t / 4000 * (by - ay)) / 10), math.floor((ax + t / 4000 * (bx - ax) - 100) / 10)) for t in range(4001)}
    walked = {p for p in walked if 0 <= p[0] < 50 and 0 <= p[1] < 40}
    square = {(49, 10), (50, 10), (49, 11), (50, 11)}  # its right and lower sides belong to the pixels beyond
    assert walked | inner <= got and len(got - walked - inner - square) <= 3
    assert pixels_of(zones.touched_runs(edges.where("polygon = 4"), GRID)) == square


def test_a_corner_is_one_pixel(spark):
    line = spark.createDataFrame([(0.0, 0.0, 30.0, 30.0)], "ax double, ay double, bx double, by double")
    assert {(r.row, r.col) for r in raster.raster_lines(line, 10.0).collect()} == {(k, k) for k in range(4)}


def test_zones_are_prepared_or_refused(spark):
    square = lambda x, y, side: rings_of(spark, {(1, 0): [(x, y), (x + side, y), (x + side, y + side), (x, y + side)]})
    whole = zones.prepare_zone(10.0, square(103, 103, 200))
    assert (whole.problem, whole.grid, whole.blocks) == (None, Grid(100, 310, 10.0, 21, 21), 1) and zones.run_area(whole.runs, 10.0).first().pixels == 400
    part = zones.prepare_zone(10.0, square(103, 103, 200), square(253, 53, 100))
    assert part.grid == Grid(250, 160, 10.0, 6, 6) and zones.run_area(part.runs, 10.0).first().pixels == 25
    assert min(r.row for r in part.runs.collect()) >= 0 and max(r.col_to for r in part.runs.collect()) < 6
    assert zones.prepare_zone(10.0, None, square(0, 0, 50)).grid.width == 5
    assert zones.prepare_zone(10.0, square(0, 0, 100), square(500, 500, 100)).problem == "mask outside"
    assert zones.prepare_zone(10.0, spark.createDataFrame([(1, 0.0, 0.0, 9.0, 9.0), (1, 9.0, 9.0, 0.0, 0.0)], EDGES)).problem == "no surface"
    assert zones.prepare_zone(10.0, spark.createDataFrame([], EDGES)).problem == "no surface"
    far = zones.prepare_zone(10.0, square(0, 0, 10_000), block=10, most=9_999)
    assert (far.problem, far.blocks) == ("too large", 10_000)
    with pytest.raises(ValueError):
        zones.prepare_zone(10.0)
    assert zones.prepare_zone(10.0, zones.box_edges(spark, (0, 0, 30, 20))).grid == Grid(0, 20, 10.0, 3, 2)


@pytest.mark.parametrize("shape", [(90, 7), (7, 90), (40, 41), (1, 30), (1, 1)])
def test_distances_are_exact_beyond_any_strip(spark, shape, monkeypatch):
    from terrafold.operators import distance

    monkeypatch.setattr(distance, "STRIP", 60)
    rng = random.Random(sum(shape))
    cells = [(r, c) for r in range(3, 3 + shape[0]) for c in range(-2, -2 + shape[1]) if rng.random() < 0.9] or [(3, -2)]
    pixels = spark.createDataFrame(cells, "row int, col int")
    for n in (0, 1, 3, 40):
        marks = [(rng.randint(0, 3 + shape[0] + 2), rng.randint(-4, shape[1])) for _ in range(n)] + ([(-10**6, 10**6)] if n == 3 else [])
        got = {(r.row, r.col): r.d for r in distance_transform(pixels, spark.createDataFrame(marks + marks[:1], "row int, col int"), 10.0).collect()}
        assert set(got) == set(cells)
        for p, d in got.items():
            assert d is None if not n else abs(d - 10 * min(math.dist(p, m) for m in marks)) < 1e-9


def test_points_within_reach(spark):
    rng = random.Random(8)
    grid = Grid(0.0, 500.0, 10.0, 60, 50)
    points = [(rng.uniform(-200, 800), rng.uniform(-200, 700)) for _ in range(6)]
    got = {(r.row, r.col): r.d for r in point_distance(raster.grid_pixels(spark, 50, 60), spark.createDataFrame(points * 2, "x double, y double"), grid, 120.0).collect()}
    for (r, c), d in got.items():
        want = min(math.dist(p, ((c + 0.5) * 10, 500 - (r + 0.5) * 10)) for p in points)
        assert d is None if want > 120 else abs(d - want) < 1e-9
    assert len(got) == 3000
