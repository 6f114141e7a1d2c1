"""Operators on small inputs with known answers."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from terrafold.functions import geo, indices, labels
from terrafold.operators import decisions, hydrology, mapping, quality, raster, review, spatial, training
from terrafold.sources import points


def test_utm_round_trip_and_known_point(spark):
    df = spark.createDataFrame([(-3.0, 0.0), (-3.4, 37.05), (7.5, 51.2)], "lon double, lat double")
    zone = geo.utm_zone(F.col("lon"))
    x, y = geo.to_utm(F.col("lon"), F.col("lat"), zone)
    got = df.select("lon", "lat", zone.alias("zone"), x.alias("x"), y.alias("y"))
    lon, lat = geo.from_utm(F.col("x"), F.col("y"), F.col("zone"))
    got = got.select("*", lon.alias("lon2"), lat.alias("lat2")).collect()
    assert abs(got[0].x - 500000) < 1e-6 and abs(got[0].y) < 1e-6  # on the central meridian and the equator
    assert abs(got[2].x - 395201.31) < 0.01 and abs(got[2].y - 5673135.24) < 0.01
    assert all(abs(r.lon - r.lon2) < 1e-8 and abs(r.lat - r.lat2) < 1e-8 for r in got)


def test_mercator_round_trip(spark):
    df = spark.createDataFrame([(-3.4, 37.05), (0.0, 89.0)], "lon double, lat double")
    x, y = geo.to_mercator(F.col("lon"), F.col("lat"))
    lon, lat = geo.from_mercator(x, y)
    a, b = df.select(lon.alias("lon"), lat.alias("lat")).collect()
    assert abs(a.lon + 3.4) < 1e-9 and abs(a.lat - 37.05) < 1e-9 and abs(b.lat - 85) < 1e-9


def test_labels(spark):
    values = ["si", "Sí", "SI", "yes", "Y", "1", "1.0", "true", "presence", "no", "N", "0", "0.0", "false", "absence", None, "", "  ", "nan", "quizás", "2", "húmedo"]
    got = [r.v for r in spark.createDataFrame([(v,) for v in values], "t string").select(labels.yes_no(F.col("t")).alias("v")).collect()]
    assert got == ["yes"] * 9 + ["no"] * 6 + [""] * 4 + ["?"] * 3


def test_years_slug_and_numbers(spark):
    row = spark.range(1).select(
        labels.year_list(F.lit("2017, 2019-2021,x")).alias("y"), labels.slug(F.lit(" Río  Único! ")).alias("s"),
        labels.first_number(F.lit("nan"), F.lit("3,5")).alias("n"), labels.clean_text(F.lit(" none ")).alias("t")).first()
    assert (row.y, row.s, row.n, row.t) == ([2017, 2019, 2020, 2021], "rio_unico", 3.5, None)


def test_decision_precedence(spark):
    rows = [(0.9, "no", True, "DOUBTFUL"), (0.1, "yes", False, "VERIFIED_YES"), (0.9, "no", False, "VERIFIED_NO"), (None, "", False, "NO_DATA"),
            (0.7, "", False, "PROBABLE"), (0.55, "", False, "POSSIBLE"), (0.2, "", None, "NO"), (0.3, "", False, "UNCERTAIN")]
    df = spark.createDataFrame(rows, "p double, label string, doubt boolean, want string")
    got = df.select(decisions.decide(F.col("p"), F.col("label"), F.col("doubt")).alias("d"), "want",
                    decisions.decide(F.col("p"), F.lit(""), F.lit(False), 0.95).alias("high")).collect()
    assert all(r.d == r.want for r in got) and got[4].high == "PROBABLE"


def test_reflectance_and_index(spark):
    df = spark.createDataFrame([(1500, 4.0, "2021-01-01"), (1500, 3.0, "2023-01-01"), (1500, None, "2022-01-25"), (500, 5.0, "2020-01-01")], "b int, base double, day string")
    got = [r.v for r in df.select(indices.reflectance(F.col("b"), F.col("base"), F.col("day").cast("date")).alias("v")).collect()]
    assert got == [500, 1500, 500, 0]


def test_depression_is_filled_and_drains(spark):
    z = {(r, c): 100.0 - r + abs(c - 3) * 2 for r in range(7) for c in range(7)}
    z[3, 3] = 0.0  # a pit
    dem = spark.createDataFrame([(r, c, v) for (r, c), v in z.items()], "row int, col int, z double")
    level = {(r.row, r.col): r.z for r in hydrology.filled(dem).collect()}
    # The pit is raised to its lowest rim towards the edge, nothing else moves.
    assert level[3, 3] == 96.0 and all(level[k] == v for k, v in z.items() if k != (3, 3))
    gathered = {(r.row, r.col): r.hectares for r in hydrology.accumulation(hydrology.receivers(hydrology.filled(dem, 1e-6), 10.0), 10.0).collect()}
    assert gathered[6, 3] > gathered[3, 3] > 0.01


def test_depressions_across_blocks(spark):
    random.seed(4)
    side = 14
    z = {(r, c): random.randint(0, 30) * 1.0 for r in range(side) for c in range(side) if (r, c) != (5, 5)}
    around = lambda r, c: [(r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i or j) and (r + i, c + j) in z]
    level = {k: v if len(around(*k)) < 8 else math.inf for k, v in z.items()}
    changed = True
    while changed:
        changed = False
        for k in z:
            low = max(z[k], min(level[n] for n in around(*k)) + 0.5)
            if low < level[k]:
                level[k], changed = low, True
    dem = spark.createDataFrame([(r, c, v) for (r, c), v in z.items()], "row int, col int, z double")
    for block in (3, 64):
        assert {(r.row, r.col): r.z for r in hydrology.filled(dem, 0.5, block).collect()} == level


def test_touched_pixels_are_exact(spark):
    random.seed(2)
    lines = [(1.0, 1.0, 39.0, 12.0), (5.0, 35.0, 8.0, 2.0), (12.0, 12.0, 12.0, 12.0), (30.0, 5.0, 11.0, 5.0)] + [tuple(round(random.uniform(0, 60), 2) for _ in range(4)) for _ in range(20)]
    for ax, ay, bx, by in lines:
        got = {(r.row, r.col) for r in raster.raster_lines(spark.createDataFrame([(ax, ay, bx, by)], "ax double, ay double, bx double, by double"), 10.0).collect()}
        walked = {(math.floor((ay + t / 5000 * (by - ay)) / 10), math.floor((ax + t / 5000 * (bx - ax)) / 10)) for t in range(5001)}
        assert walked <= got and len(got) <= len(walked) + 2


def test_nearest_distance_at_any_scale(spark):
    random.seed(6)
    rows = [(i, random.uniform(-900, 900), random.uniform(-900, 900)) for i in range(60)]
    layer = [(i, random.gauss(300, 5), random.gauss(-200, 5)) for i in range(40)] + [(99, -800.0, 700.0), (98, -800.0, 700.0)]
    for some in (layer, layer[:1]):
        got = {r.from_id: r.d for r in spatial.nearest_distance(spark.createDataFrame(rows, "from_id long, x double, y double"), spark.createDataFrame(some, "id long, x double, y double"), 10.0).collect()}
        assert all(abs(got[i] - min(math.dist((x, y), p[1:]) for p in some)) < 1e-9 for i, x, y in rows) and len(got) == len(rows)


def test_maps_are_whole_or_absent(spark, tmp_path):
    px = raster.grid_pixels(spark, 6, 5).withColumn("code", F.col("row") % 3)
    path = f"file://{tmp_path}/map"
    mapping.write_map(px, path, {"cell": 10}, 4)
    back, about = mapping.read_map(spark, path)
    assert about == {"cell": 10} and {(r.row, r.col, r.code) for r in back.collect()} == {(r, c, r % 3) for r in range(6) for c in range(5)}
    with pytest.raises(FileExistsError):
        mapping.write_map(px, path, {})
    with pytest.raises(Exception):
        mapping.write_map(px.withColumn("code", F.raise_error(F.lit("stop"))), f"{path}2", {})
    with pytest.raises(FileNotFoundError):
        mapping.read_map(spark, f"{path}2")


def test_blocks_are_read_once(spark, tmp_path):
    asked = []

    def compute(missing):
        asked.append(sorted((r.block_row, r.block_col) for r in missing.collect()))
        return missing.select("block_row", "block_col", (F.col("block_row") * 10 + F.col("block_col")).alias("v"))

    blocks = lambda *at: spark.createDataFrame(list(at), "block_row int, block_col int")
    path = f"file://{tmp_path}/cache"
    assert mapping.cached_blocks(blocks((0, 0), (0, 1)), compute, path, "k").count() == 2
    got = mapping.cached_blocks(blocks((0, 1), (2, 0)), compute, path, "k")
    assert {r.v for r in got.collect()} == {1, 20} and mapping.cached_blocks(blocks((0, 1)), compute, path, "k").count() == 1
    assert asked == [[(0, 0), (0, 1)], [(2, 0)]]


def test_reviews_are_all_or_none(spark):
    rows = spark.createDataFrame([(1, "lake", "wet", False, "slope", "dry"), (2, "", "", False, "slope", "dry")], "id int, setting string, wetness string, reviewed boolean, setting_rule string, wetness_rule string")
    levels = {k: review.LEVELS[k] for k in ("setting", "wetness")}
    chosen = lambda *at: spark.createDataFrame(list(at), "id int, setting string, wetness string")
    done = review.set_review(rows, chosen((1, "stream", None)), "id", levels).orderBy("id").collect()
    assert (done[0].setting, done[0].wetness, done[0].reviewed, done[1].reviewed) == ("stream", "wet", True, False)
    with pytest.raises(ValueError):
        review.set_review(rows, chosen((1, "stream", None), (2, "lake", None)), "id", levels)
    assert review.clear_review(rows, levels).first().setting == "slope"


def test_zones_and_classes(spark):
    px = spark.createDataFrame([(0, 0, 0.5, [0.5, 0.3, 0.2]), (0, 1, None, [0.1, 0.5, 0.4]), (0, 2, 0.1, [0.4, 0.3, 0.3])], "row int, col int, v double, p array<double>")
    code = lambda **k: [r.code for r in mapping.classify(px, ["v"], F.col("p"), **k).orderBy("col").collect()]
    assert code() == [0, None, 0] and code(threshold=0.5) == [1, None, 1] and code(with_absence=False) == [1, None, 1] and code(allowed=F.col("col") < 2, threshold=0.55) == [0, None, None]
    got = spark.createDataFrame([(0, 2), (3, 1), (3, 0), (1, 7)], "b int, l int").select(mapping.composed(F.col("b"), F.col("l"), 2).alias("c")).collect()
    assert [r.c for r in got] == [None, 5, 0, None]
    a, b = px.select("row", "col"), px.select("row", "col").orderBy(F.desc("col"))
    assert mapping.signature(a, ["row", "col"]).first() == mapping.signature(b, ["row", "col"]).first() != mapping.signature(a.limit(2), ["row", "col"]).first()


def test_bilinear_and_lines(spark):
    px = raster.grid_pixels(spark, 3, 3).withColumn("v", (F.col("row") * 10 + F.col("col")).cast("double"))
    at = spark.createDataFrame([(1, 0.5, 0.25), (2, 2.0, 2.0), (3, 2.5, 1.0)], "from_id int, r double, c double")
    got = {r.from_id: r.value for r in raster.bilinear(at, px, "v").collect()}
    assert got == {1: 5.25, 2: 22.0, 3: None}
    line = spark.createDataFrame([(5.0, 5.0, 35.0, 5.0)], "ax double, ay double, bx double, by double")
    assert {(r.row, r.col) for r in raster.raster_lines(line, 10.0).collect()} == {(0, 0), (0, 1), (0, 2), (0, 3)}


def test_texture_of_flat_and_checked_windows(spark):
    px = spark.createDataFrame([(w, r, c, 0 if w == 0 else (r + c) % 2) for w in (0, 1) for r in range(4) for c in range(4)], "window int, row int, col int, g int")
    got = {r.window: r for r in raster.texture(px, "g").collect()}
    assert got[0].contrast == 0 and got[0].energy == 1 and 0 < got[1].contrast < 1


def test_terrain_of_a_plane(spark):
    px = raster.grid_pixels(spark, 4, 4).withColumn("z", F.col("col") * 10.0)
    r = raster.terrain(px, "z", 10.0).where("row = 1 and col = 1").first()
    assert abs(r.slope - 45) < 1e-9 and abs(r.curvature) < 1e-9


def test_spaced_points_keep_apart_and_are_maximal(spark):
    pts = spatial.uniform_in_box(spark, 300, (0.0, 0.0, 10.0, 10.0), 7)
    xy = {r.id: (r.x, r.y) for r in pts.collect()}
    kept = [r.id for r in spatial.spaced(pts, 1.0).collect()]
    d = lambda a, b: math.dist(xy[a], xy[b])
    assert all(d(a, b) >= 1 for a in kept for b in kept if a < b) and all(any(d(a, b) < 1 for b in kept) for a in xy if a not in kept)


def test_bounded_distance_is_exact_within_its_reach(spark):
    pixels, marked = raster.grid_pixels(spark, 9, 12), [(2, 3), (7, 10)]
    got = {(r["row"], r["col"]): r.d for r in raster.bounded_distance(pixels, spark.createDataFrame(marked, "row int, col int"), 3, 10.0).collect()}
    assert len(got) == 108
    for (r, c), d in got.items():
        best = min(math.hypot(r - i, c - j) for i, j in marked)
        assert d is None if best > 3 else abs(d - best * 10) < 1e-9


def test_segment_distance(spark):
    got = spark.range(1).select(*[spatial.segment_distance(*[F.lit(float(v)) for v in p]) for p in ((0, 5, -1, 0, 1, 0), (5, 0, 0, 0, 2, 0), (3, 4, 0, 0, 0, 0))]).first()
    assert list(got) == [5.0, 3.0, 5.0]


def test_inflation_and_elimination(spark):
    df = spark.range(200).select((F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 11).cast("double").alias("b"), ((F.col("id") % 7) * 2.0 + 1).alias("c"), F.lit(1.0).alias("k"))
    v = quality.inflation(df, ["a", "b", "c", "k"])
    assert math.isinf(v["a"]) and math.isinf(v["c"]) and v["b"] < 1.1 and math.isnan(v["k"])
    assert [c for c, _ in quality.eliminate(df, ["a", "b", "c", "k"])] == ["k", "c"]


def test_forest_permutation_and_self_training(spark):
    df = spark.range(240).select("id", (F.col("id") % 2).cast("double").alias("code"), (F.col("id") % 2 + (F.col("id") % 5) / 10).alias("good"), ((F.col("id") * 37) % 11).cast("double").alias("noise"))
    model = training.fit_forest(df, "code", ["good", "noise"], trees=5, depth=4)
    found = training.permutation_importance(model, df.withColumn("code", F.col("code").cast("int")), "code", "id", {"good": ["good"], "noise": ["noise"]}, 2)
    assert found[0][0] == "good" and found[0][1] > 0.2
    rows = df.select("id", "good", "noise", F.when(F.col("id") < 20, F.when(F.col("code") == 1, F.lit("yes")).otherwise(F.lit("no"))).otherwise(F.lit("")).alias("label"), F.lit(False).alias("doubtful"))
    positives, news = training.self_training(rows, ["good", "noise"], 3, trees=5, depth=3, least=1)
    assert news[0] > 0 and {r.id % 2 for r in positives.collect()} == {1}


def test_exact_quantiles(spark):
    from terrafold.operators.quantiles import exact_quantiles

    random.seed(9)
    groups = {"a": [random.gauss(0, 1) for _ in range(700)], "b": [1.0] * 50 + [2.0], None: [5.0, 6.0], "c": [float(i // 40) for i in range(400)]}
    rows = [(k, v) for k, some in groups.items() for v in some] + [("a", None), ("a", float("nan")), ("d", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    names = {f"q{int(q * 100)}": q for q in (0.0, 0.1, 0.5, 0.85, 1.0)}

    def at(some, q):
        some, x = sorted(some), q * (len(some) - 1)
        return some[int(x)] + (some[math.ceil(x)] - some[int(x)]) * (x - int(x))

    got = {r.k: r for r in exact_quantiles(df, ["k"], "v", names, 8, 20).collect()}
    assert set(got) == set(groups) and all(got[k].n == len(some) and all(abs(got[k][name] - at(some, q)) < 1e-12 for name, q in names.items()) for k, some in groups.items())
    assert got == {r.k: r for r in exact_quantiles(df, ["k"], "v", names).collect()}
    (all_,) = exact_quantiles(df, [], "v", {"m": 0.5}, 4, 50).collect()
    assert abs(all_.m - at([v for some in groups.values() for v in some], 0.5)) < 1e-12
    assert exact_quantiles(df.limit(0), ["k"], "v", names).count() == 0


def test_models_are_saved_with_their_description(spark, tmp_path):
    rows = spark.range(120).select("id", (F.col("id") % 2).cast("double").alias("code"), (F.col("id") % 2 + (F.col("id") % 5) / 10).alias("good"), (F.col("id") % 7).cast("double").alias("noise"))
    model, path = training.fit_forest(rows, "code", ["good", "noise"], trees=3, depth=3), f"file://{tmp_path}/model"
    with pytest.raises(ValueError):
        training.save_model(model, path, {"classes": [0, 1]})
    training.save_model(model, path, {"classes": [0, 1], "n_rows": 120})
    back, about = training.load_model(spark, path)
    score = lambda m: [r.predicted for r in training.predict(m, rows).orderBy("id").collect()]
    assert score(back) == score(model) and about["n_rows"] == 120 and about["predictors"] == ["good", "noise"] and back.medians == model.medians
    table = training.importance_table(spark, model).collect()
    assert [r.variable for r in table] == ["good", "noise"] and len(table[0].importance.partition(".")[2]) == 6
    few = rows.select("id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.when(F.col("id") < 20, F.lit("yes")).otherwise(F.lit("")).alias("label"), F.lit(False).alias("doubtful"), "good", "noise")
    assert training.detector(few, ["good", "noise"], path)[1] == "saved" and training.detector(few, ["good", "noise"]) == (None, "none")
    many = few.withColumn("x", F.col("id") * 100.0)
    assert training.detector(many, ["good", "noise"], path, trees=3, depth=3)[1] == "own"


def test_a_row_is_predicted_alike_in_any_company(spark, tmp_path):
    code = F.col("id") % 2
    rows = spark.range(200).select("id", code.cast("double").alias("code"), F.when(F.col("id") % 5 != 0, code + (F.col("id") % 7) / 20).alias("good"), F.when(F.col("id") % 3 != 0, (F.col("id") % 11).cast("double")).otherwise(F.lit(float("nan"))).alias("noise"))
    model = training.fit_forest(rows, "code", ["good", "noise"], trees=10, depth=4)
    known = sorted(r.good for r in rows.where("good is not null").collect())
    assert abs(model.medians["good"] - (known[79] + known[80]) / 2) < 1e-12
    training.save_model(model, f"file://{tmp_path}/m", {"classes": [0, 1], "n_rows": 200})
    back, _ = training.load_model(spark, f"file://{tmp_path}/m")
    score = lambda m, some: {r.id: r.probabilities for r in training.predict(m, some).collect()}
    whole = score(model, rows)
    for some in (rows.where("id = 15"), rows.where("id < 50"), rows.where("id % 5 = 0")):
        part = score(back, some)
        assert part and all(whole[i] == p for i, p in part.items())
    nulls = training.predict(back, rows.where("id = 15")).first()
    assert nulls.good is None  # what was missing stays missing


def test_forest_strategies_and_parameters(spark):
    rows = spark.range(300).select("id", F.when(F.col("id") % 10 == 0, F.lit(1.0)).otherwise(F.lit(0.0)).alias("code"), (F.col("id") % 10).cast("double").alias("a"))
    for strategy in training.STRATEGIES:
        model = training.fit_forest(rows, "code", ["a"], trees=10, depth=None, strategy=strategy, key="id")
        assert {r.id for r in training.predict(model, rows).where("predicted = 1").collect()} == set(range(0, 300, 10))
    assert training.fit_forest(rows, "code", ["a"], trees=10, strategy="undersample", ratio=2.0, key="id").medians["a"] < 4.5
    for bad in ({"strategy": "other"}, {"strategy": "both"}, {"least": 0}, {"depth": 0}, {"subset": "half"}):
        with pytest.raises(ValueError):
            training.fit_forest(rows, "code", ["a"], trees=10, **bad)


def test_absences_lie_farther_than_the_buffer(spark):
    rows = [(1, 0.0, 0.0, "yes", False), (2, 250.0, 0.0, "", False), (3, 250.001, 0.0, "", False), (4, 900.0, 0.0, "yes", True), (5, 901.0, 0.0, "", None), (6, 1.0, 0.0, "no", False), (7, 5000.0, 0.0, "", True), (8, 5000.0, 0.0, None, None)]
    got = {r.id: r.code for r in training.presence_labels(spark.createDataFrame(rows, "id long, x double, y double, label string, doubtful boolean")).collect()}
    assert got == {1: 1.0, 2: None, 3: 0.0, 4: None, 5: None, 6: 0.0, 7: None, 8: 0.0}


def test_results_for_a_next_run(spark):
    rows = spark.createDataFrame([("a", 1.0, 2.0, {"label": "yes", "origin": "auto", "proba": "0.123456", "ndvi": "0.5", "_x": "1"}), ("b", 1.0, 2.0, {"source": "truth"}), ("c", 0.0, 0.0, {"label": "no", "proba": "-"})],
                                 "id string, lon double, lat double, attrs map<string,string>")
    got = [json.loads(r.value)["properties"] for r in points.result_features(rows, ["ndvi"]).collect()]
    assert got == [{"origin": "auto", "proba": "0.1235", "ID": "a"}, {"label": "no", "proba": "-", "ID": "c"}]


def test_readers_and_sinks(spark, tmp_path):
    kml = tmp_path / "a.kml"
    kml.write_text("""<?xml version="1.0"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document><Placemark><name>p1</name><ExtendedData><SchemaData><SimpleData name="fid">7</SimpleData>
<SimpleData name="kind">wet</SimpleData></SchemaData></ExtendedData><Point><coordinates>-3.1,37.2,5 -3.0,37.0</coordinates></Point></Placemark>
<Placemark><name>p2</name><Point><coordinates>1.5,2.5</coordinates></Point></Placemark><Placemark><name>line</name></Placemark></Document></kml>""")
    rows = points.read_kml(spark, str(kml)).orderBy("id").collect()
    assert [(r.id, r.lon, r.lat) for r in rows] == [("p1", -3.1, 37.2), ("p2", 1.5, 2.5)] and rows[0].attrs["kind"] == "wet"
    feature = lambda kind, xy, props: {"type": "Feature", "geometry": {"type": kind, "coordinates": xy}, "properties": props}
    gj = tmp_path / "a.geojson"
    gj.write_text(json.dumps({"type": "FeatureCollection", "features": [
        feature("Point", [1.0, 2.0], {"ID": "a", "label": "si", "_x": "1"}), feature("MultiPoint", [[3.0, 4.0], [5.0, 6.0]], {"name": "b"}), feature("LineString", [[0, 0], [1, 1], [2, 0]], {})]}))
    got = points.read_geojson(spark, str(gj)).orderBy("id")
    assert [(r.id, r.lon, r.lat) for r in got.collect()] == [("a", 1.0, 2.0), ("b", 3.0, 4.0)]
    assert points.read_lines(spark, str(gj)).count() == 2
    out = [json.loads(r.value) for r in points.geojson_features(got).collect()]
    assert out[0]["properties"] == {"ID": "a", "label": "si"} and out[0]["geometry"]["coordinates"] == [1.0, 2.0]
    points.write_csv([spark.createDataFrame([(1, "x")], "a int, b string"), spark.createDataFrame([(2, 0.5)], "a int, c double")], str(tmp_path / "csv"))
    back = points.read_csv(spark, str(tmp_path / "csv"), ["c"]).orderBy("a")
    assert back.columns == ["a", "b", "c"] and [r.c for r in back.collect()] == [None, 0.5]


def test_stream_of_observations(spark, tmp_path):
    from terrafold.streaming.observations import read_stream, windowed_stats

    rows = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, id) AS ts, id % 2 AS k, cast(id AS double) AS v FROM range(240)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = windowed_stats(read_stream(spark, str(tmp_path / "in"), rows.schema), "ts", ["k"], "v", "1 day", "0 seconds")
    q = stream.writeStream.format("memory").queryName("seen").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT count(*) AS n, sum(n) AS rows FROM seen").first()
    assert (got.n, got.rows) == (20, 240)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "row int, col int")
    assert raster.patches(none).count() == 0 and raster.dilate(none).count() == 0
    pts = spark.createDataFrame([], "from_id long, x double, y double")
    layer = spark.createDataFrame([], "id long, x double, y double")
    assert spatial.nearest_distance(pts, layer, 10.0).count() == 0
