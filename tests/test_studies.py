"""Learning rounds, runs, folds, points in areas and textures on small inputs with known answers."""

import math
import random

import pytest
from pyspark.sql import functions as F

from terrafold.operators import learning, raster, resampling, samples, spatial, texture, zones


def learners(spark):
    code = F.col("id") % 2
    label = F.when(F.col("id") < 40, F.when(code == 1, F.lit("yes")).otherwise(F.lit("no"))).otherwise(F.lit(""))
    return spark.range(240).select("id", (F.col("id") * 1.0).alias("x"), F.lit(0.0).alias("y"), label.alias("label"), (F.col("id") == 41).alias("doubtful"), (code + (F.col("id") % 5) / 10).alias("good"), F.lit("slope").alias("setting_proposed"), F.lit("wet").alias("wetness_proposed"))


def test_learning_goes_on_where_it_stopped(spark, tmp_path):
    path, options = f"file://{tmp_path}/rounds", {"trees": 10, "depth": 3}
    assert learning.state(spark, path) is None
    learning.begin(learners(spark), path, ["good"], **options)
    learning.begin(learners(spark).limit(3), path, ["good"], **options)  # does nothing: there is a round
    first = learning.next_round(spark, path, ["good"], cutoff=0.6, **options)
    assert first["n_base"] == first["n_prev_pos"] == 20 and first["n_new"] == 99 and first["n_train_pos"] == 119  # all odd ids but the doubtful one
    spark.range(1).write.parquet(f"{path}/round=2/points")  # a round that broke off
    assert learning.state(spark, path)[1] == 1
    told = learning.learn(spark, path, ["good"], 5, cutoff=0.6, **options).orderBy("round").collect()
    assert [(r.round, r.n_new, r.converged) for r in told] == [(0, 0, False), (1, 99, False), (2, 0, True)] and {r.model for r in told} == {"own"}
    points, number = learning.state(spark, path)
    seen = {r.id: r for r in points.collect()}
    assert number == 2 and len(seen) == 240
    assert (seen[1].origin, seen[1].decision, seen[43].origin, seen[43].decision, seen[41].origin, seen[2].origin) == ("verified", "VERIFIED_YES", "auto", "AUTO", "doubtful", "verified")
    assert seen[43].setting == "slope" and seen[44].setting == ""  # types follow the decisions
    learning.verify(spark, path, spark.createDataFrame([(43, "no"), (44, "yes"), (41, "yes")], "id long, label string"))
    again = learning.next_round(spark, path, ["good"], cutoff=0.6, mode="replace", **options)
    points = {r.id: r for r in learning.state(spark, path)[0].collect()}
    assert again["n_base"] == 22 and points[43].label == "no" and points[43].origin == "verified" and points[44].decision == "VERIFIED_YES" and points[41].origin == "verified"
    with pytest.raises(ValueError):
        learning.next_round(spark, path, ["good"], mode="other")


def test_only_like_runs_are_compared(spark, tmp_path):
    path = f"file://{tmp_path}/runs"
    rows = spark.createDataFrame([(1, 0), (2, 1)], "id int, code int")
    mine, other = learning.sample_signature(rows, "id", "code"), learning.sample_signature(rows.limit(1), "id", "code")
    assert mine == learning.sample_signature(rows.orderBy(F.desc("id")), "id", "code") != other
    for run, samples_, reading, f1 in (("a", mine, "r", 0.5), ("b", mine, "r", 0.75), ("c", other, "r", 0.9), ("d", mine, "s", 0.9)):
        learning.record_run(spark, path, run, "setting", samples_, reading, ["p", run], 2, f1)
    runs = spark.read.parquet(path)
    assert learning.compared_runs(runs, "b", "a").first().gain == 0.25
    assert {r.run for r in learning.comparable_runs(runs, "a").collect()} == {"a", "b", "d"}
    for wrong, why in (("c", "samples"), ("d", "reading"), ("e", "no such run")):
        with pytest.raises(ValueError, match=why):
            learning.compared_runs(runs, "a", wrong)
    learning.check_pair({"reading": "r", "classes": [0, 1]}, {"reading": "r", "classes": [0, 1, 2]})
    for first, second in (({"reading": "r", "classes": [0, 1]}, {"reading": "s"}), ({"reading": "r", "classes": [0, 1, 2]}, {"reading": "r"})):
        with pytest.raises(ValueError):
            learning.check_pair(first, second)


def test_folds_and_their_warnings(spark):
    rng = random.Random(3)
    rows = spark.createDataFrame([(i, f"z{rng.randint(0, 11)}", rng.choice([0, 0, 1, 2]) if i else 9) for i in range(600)], "id long, zone string, code int")
    out, kind, told = samples.spatial_folds(rows, "id", "zone", "code", 4)
    assert kind == "groups" and told == [("class in one group", 9)] and out.count() == 600
    assert out.groupBy("zone").agg(F.count_distinct("fold").alias("k")).where("k > 1").count() == 0
    shares = out.where("code < 9").groupBy("fold").pivot("code", [0, 1, 2]).count().collect()
    assert len(shares) == 4 and all(max(r[str(c)] for r in shares) <= 2.2 * min(r[str(c)] for r in shares) for c in (0, 1, 2))
    out, kind, told = samples.spatial_folds(rows.where("code < 9").withColumn("zone", F.lit("one")), "id", "zone", "code", 5)
    assert kind == "classes" and told == [("no groups", 1)]
    sizes = out.groupBy("code", "fold").count().collect()
    assert all(abs(a["count"] - b["count"]) <= 1 for a in sizes for b in sizes if a.code == b.code) and len(sizes) == 15
    assert samples.spatial_folds(rows.limit(0), "id", "zone", "code")[0].count() == 0


def test_points_in_areas(spark):
    ring = lambda *xy: zones.ring_edges(spark.createDataFrame([(1, 0, i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "polygon int, ring int, at int, x double, y double"))
    triangle = ring((0, 0), (100, 0), (0, 100))
    points, tried = spatial.uniform_in_area(triangle, 60, 5)
    got = sorted((r.id, r.x, r.y) for r in points.collect())
    assert len(got) == 60 and all(x + y <= 100 + 1e-6 for _, x, y in got) and tried < 60 * 200
    assert got == sorted((r.id, r.x, r.y) for r in spatial.uniform_in_area(triangle, 60, 5)[0].collect())
    more = sorted((r.id, r.x, r.y) for r in spatial.uniform_in_area(triangle, 90, 5)[0].collect())
    assert more[:60] == got  # the first ones inside, whatever is asked
    thin = ring((0, 0), (1000, 1000), (1000, 1000.0001))
    few, tried = spatial.uniform_in_area(thin, 5, 1)
    assert few.count() < 5 and tried == 1000
    high = lambda p: p.withColumn("z", F.when(F.col("x") > 20, F.col("x")))
    kept, about = spatial.random_points(triangle, 30, high, low=40.0, high=70.0, avoid=spark.createDataFrame([(50.0, 10.0)], "x double, y double"), far=15.0)
    rows = kept.collect()
    assert rows and all(40 <= r.z <= 70 and math.dist((r.x, r.y), (50, 10)) >= 15 for r in rows) and about["excluded"] > 0 and about["kept"] == len(rows) <= 30
    reason = lambda **k: spatial.random_points(triangle, 10, k.pop("z", high), **k)[1]["reason"]
    assert (reason(low=500.0), reason(high=5.0), reason(low=1.0, z=lambda p: p.withColumn("z", F.lit(None).cast("double")))) == ("low above area", "high below area", "no elevations")
    layered, _ = spatial.random_points(triangle, 20, high, stratified=True)
    assert 5 <= layered.count() <= 20
    with pytest.raises(ValueError):
        spatial.random_points(triangle, 5, None, low=1.0)


def test_openings_are_those_of_a_disk(spark):
    rng, side = random.Random(5), 14
    masks = {0: {(r, c) for r in range(side) for c in range(side)}, 1: {(r, c) for r in range(side) for c in range(side) if rng.random() < 0.93}, 2: {(7, 7)}, 3: {(r, c) for r in range(9) for c in range(3, 12)}}
    runs = texture.mask_runs(spark.createDataFrame([(w, r, c) for w, some in masks.items() for r, c in some], "window int, row int, col int"))
    for radius in (1, 2, 3):
        disk = [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if i * i + j * j <= radius * radius]
        on = lambda r, c: 0 <= r < side and 0 <= c < side
        got = {w: set() for w in masks}
        for x in texture.opened(runs, side, radius).collect():
            got[x.window] |= {(x.row, c) for c in range(x.col_from, x.col_to + 1)}
        for w, some in masks.items():
            left = {(r, c) for r in range(side) for c in range(side) if all((r + i, c + j) in some or not on(r + i, c + j) for i, j in disk)}
            assert got[w] == {(r + i, c + j) for r, c in left for i, j in disk if on(r + i, c + j)}


def test_screens_choose_overviews(spark):
    assert resampling.sampling(10.0, 0.0, 10.0, [1, 2, 4]) == (1, 1) and resampling.sampling(30.0, 0.0, 10.0, [1, 2, 4]) == (2, 2)
    assert resampling.sampling(1000.0, 0.0, 10.0, [1, 2, 4]) == (4, 8) and resampling.sampling(24.0, 60.0, 10.0, [1, 2, 4]) == (1, 2)
    points, res, box = resampling.screen(spark, (-1.0, 10.0, 1.0, 11.0), 6)
    assert points.count() == (box[2] - box[0]) * (box[3] - box[1]) and abs(res - 2445.98) < 0.01
    assert resampling.screen(spark, (-1.0, 10.0, 1.0, 11.0), 16, 10_000)[0].count() < 10_500
    empty = raster.grid_pixels(spark, 1, 1).withColumn("v", F.lit(1.0))
    out = resampling.view_of({1: empty}, "v", zones.Grid(0.0, 0.0, 10.0), 30, (-3.0, 40.0, -2.99, 40.01), 10, categories=False)
    assert {r.v for r in out.collect()} == {None}


def test_sample_lists():
    assert samples.catalogue_union(["a", "b", "c"], ["c"], ["a", "c"]) == ["a", "c"]
    with pytest.raises(ValueError):
        samples.catalogue_union(["a"], ["z"])


def test_rows_that_do_not_train(spark):
    rows = spark.createDataFrame([(1, "truth"), (2, None), (3, "field")], "id int, source string")
    assert [r.id for r in samples.without_truth(rows).orderBy("id").collect()] == [2, 3]
    assert [r.id for r in samples.without(rows, rows.where("id = 2"), "id").orderBy("id").collect()] == [1, 3]


def test_polygons_of_files(spark, tmp_path):
    import json

    from terrafold.sources import points

    square = lambda x, y, side: [[x, y], [x + side, y], [x + side, y + side], [x, y + side], [x, y]]
    feature = lambda kind, xy: {"type": "Feature", "geometry": {"type": kind, "coordinates": xy}, "properties": {}}
    flat = {"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "urn:ogc:def:crs:EPSG::25830"}}, "features": [
        feature("Polygon", [square(467000, 4102000, 100), square(467040, 4102040, 20)]), feature("Point", [467000, 4102000]), feature("MultiPolygon", [[square(467300, 4102000, 50)], [square(467400, 4102000, 10)]])]}
    (tmp_path / "a.geojson").write_text(json.dumps(flat))
    rings = points.read_polygons(spark, f"{tmp_path}/a.geojson")
    assert rings.select("polygon").distinct().count() == 3 and {r.ring for r in rings.collect()} == {0, 1}
    edges = zones.ring_edges(points.projected_rings(rings, 30))
    grid = zones.Grid(466990.0, 4102110.0, 10.0, 60, 12)
    assert zones.run_area(zones.zone_runs(edges, grid), 10.0).first().pixels == 100 - 4 + 25 + 1
    (tmp_path / "b.geojson").write_text(json.dumps({"type": "Feature", "crs": {"properties": {"name": "EPSG:32730"}}, "geometry": {"type": "Point", "coordinates": [500000.0, 9999000.0]}, "properties": {"ID": "s"}}))
    (p,) = points.read_geojson(spark, f"{tmp_path}/b.geojson").collect()
    assert abs(p.lon + 3) < 1e-9 and -0.0091 < p.lat < -0.0090
    (tmp_path / "c.geojson").write_text(json.dumps({"type": "FeatureCollection", "crs": {"properties": {"name": "EPSG:3857"}}, "features": [feature("Point", [1.0, 2.0])]}))
    with pytest.raises(Exception, match="not known"):
        points.read_geojson(spark, f"{tmp_path}/c.geojson").collect()
    with pytest.raises(ValueError, match="no polygons"):
        points.read_polygons(spark, f"{tmp_path}/c.geojson")


def test_findings_of_tables(spark):
    from terrafold.operators import quality

    rows = spark.range(40).select((F.col("id") * 1.0).alias("a"), (F.col("id") * 1.0).alias("b"), (F.col("id") * -1.0).alias("c"), F.lit(2.0).alias("k"), (F.col("id") % 2 * 1.0).alias("d"), F.lit(None).cast("double").alias("none"))
    got = {(r.finding, r.a, r.b) for r in quality.table_findings(rows, ["a", "b", "c", "k", "d", "none"]).collect()}
    assert got == {("duplicate", "a", "b"), ("opposite", "a", "c"), ("opposite", "b", "c"), ("constant", "k", None)}
    few = {(r.finding, r.value) for r in quality.table_findings(rows.where("id < 3" if "id" in rows.columns else "a < 3"), ["a", "d", "k", "none"]).collect()}
    assert ("fewer rows than columns", 3.0) in few
    assert quality.table_findings(rows.limit(0), ["a", "b"]).count() == 0
