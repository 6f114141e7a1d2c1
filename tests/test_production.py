"""The map producer against the same forest applied by hand."""

import math
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from terrafold.operators import mapping, production, raster, training, zones
from terrafold.operators.zones import Grid
from terrafold.plans import maps, views
from terrafold.sources.tables import saved

SF = Path("/root/testdata")


def trees_of(spark, path):
    """Nodes of a saved forest: for each tree by id, (feature, threshold, left, right, class shares)."""
    trees = {}
    for r in spark.read.parquet(f"{path}/forest/data").collect():
        n = r.nodeData
        split = None if n.leftChild < 0 else (n.split.featureIndex, n.split.leftCategoriesOrThreshold[0])
        trees.setdefault(r.treeID, {})[n.id] = (split, n.leftChild, n.rightChild, list(n.impurityStats))
    return trees


def by_hand(trees, values):
    total = None
    for nodes in trees.values():
        at = 0
        while nodes[at][0]:
            feature, threshold = nodes[at][0]
            at = nodes[at][1] if values[feature] <= threshold else nodes[at][2]
        stats = nodes[at][3]
        part = [x / sum(stats) for x in stats]
        total = part if total is None else [a + b for a, b in zip(total, part)]
    return [x / sum(total) for x in total]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_a_map_is_what_the_forest_says(spark, tmp_path, sf):
    if not (SF / sf).exists():
        pytest.skip("no tables")
    px = views.pixels(spark, str(SF / sf))
    model = training.fit_forest(maps.samples_of_map(px), "code", maps.PREDICTORS_OF_MAP, trees=10, depth=6)
    training.save_model(model, f"file://{tmp_path}/model", {"classes": ["absence", "wet", "dry"], "n_rows": 1})
    back, about = training.load_model(spark, f"file://{tmp_path}/model")
    zone = zones.prepare_zone(10.0, maps._edges(spark, str(SF / sf)))
    down, right = int(-zone.grid.y0 // 10), int(zone.grid.x0 // 10)
    placed = maps.bands(px).withColumns({"row": F.col("row") - down, "col": F.col("col") - right})
    read = lambda blocks: placed.withColumns({"block_row": raster.block_of()[0], "block_col": raster.block_of()[1]}).join(blocks, ["block_row", "block_col"], "left_semi")
    args = (back, about, read, maps.BANDS_OF_MAP, zone)
    told = production.produce_map(*args, f"file://{tmp_path}/map", f"file://{tmp_path}/store", production.Rules(threshold=0.5, remove_water=True), ndwi="ndwi", slope="slope", purity=production.Purity("early", "ndwi"))
    mapped, kept = mapping.read_map(spark, f"file://{tmp_path}/map")
    assert kept["classes"] == told["classes"] and kept["pixels_in_zone"] == told["zone"]["pixels"] or told["pixels_in_zone"] <= told["zone"]["pixels"]
    trees = trees_of(spark, f"{tmp_path}/model")
    inside = {(r.row, r.col) for r in zones.run_pixels(zone.runs).collect()}
    bands = {(r.row, r.col): r for r in placed.collect()}
    rows = mapped.collect()
    n_classified = n_inside = 0
    for r in rows:
        b = bands[r.row, r.col]
        n_inside += (r.row, r.col) in inside
        if (r.row, r.col) not in inside or b.value is None:
            assert r["class"] is None and r.p_max is None and r.probabilities is None
            continue
        n_classified += 1
        p = by_hand(trees, [b.value, b.wetness, b.z])
        assert all(abs(x - y) < 1e-6 for x, y in zip(p, r.probabilities))
        total = p[1] + p[2]
        if abs(total - 0.5) > 1e-6 and abs(p[1] - p[2]) > 1e-6:
            kind = 0 if total < 0.5 or r.lake_water else 1 if p[1] > p[2] else 2
            assert r["class"] == (0 if kind == 0 else (r.setting - 1) * 2 + kind)
            assert abs(r.p_max - (p[0] if kind == 0 else max(p[1:]))) < 1e-6
            assert (r.purity is not None) == (kind > 0)
    assert n_classified == told["pixels_classified"] and n_inside > 0.5 * len(bands)
    # Distances are to the water that is left: patches of three pixels or more.
    water = {(r.row, r.col) for r in rows if r.lake_water}
    for r in rows[:: max(1, len(rows) // 200)]:
        assert r.d_water is None if not water else abs(r.d_water - 10 * min(math.dist((r.row, r.col), w) for w in water)) < 1e-6


def test_a_map_goes_on_where_it_stopped(spark, tmp_path):
    px = raster.grid_pixels(spark, 300, 20).withColumns({"a": (F.col("row") % 7).cast("double"), "b": (F.col("col") % 5).cast("double")})
    rows = px.limit(400).withColumn("code", (F.col("a") > 3).cast("double"))
    model = training.fit_forest(rows, "code", ["a", "b"], trees=10, depth=3)
    about = {"classes": ["absence", "wet"]}
    zone = zones.prepare_zone(10.0, zones.box_edges(spark, (0, 0, 200, 3000)))
    asked = []

    def read(blocks, fail=False):
        asked.append(sorted((r.block_row, r.block_col) for r in blocks.collect()))
        got = px.withColumns({"block_row": raster.block_of()[0], "block_col": raster.block_of()[1]}).join(blocks, ["block_row", "block_col"], "left_semi")
        return got.withColumn("a", F.when(F.col("row") == 299, F.raise_error(F.lit("stop"))).otherwise(F.col("a"))) if fail else got

    run = lambda read_, path, **more: production.produce_map(model, about, read_, ["a", "b"], zone, f"file://{tmp_path}/{path}", f"file://{tmp_path}/store", production.Rules(threshold=0.5), **more)
    with pytest.raises(Exception):
        run(lambda blocks: read(blocks, True), "one")
    assert not (tmp_path / "one").exists()
    told = run(read, "two")
    again = run(read, "three")
    assert asked == [[(0, 0), (1, 0)]] * 2 and told["pixels_classified"] == again["pixels_classified"] == 6000  # what failed is asked again, what is stored is not
    assert told["classes"][0]["pixels"] + sum(c["pixels"] for c in told["classes"][1:]) == 6000
    with pytest.raises(ValueError, match="no surface"):
        production.produce_map(model, about, read, ["a", "b"], zones.Zone("no surface"), "x", "y")
    with pytest.raises(ValueError, match="classes"):
        production.produce_map(model, {"classes": ["absence", "wet", "dry"]}, read, ["a", "b"], zone, "x", "y")
    with pytest.raises(ValueError, match="needs"):
        production.produce_map(model, about, read, ["a"], zone, f"file://{tmp_path}/four", f"file://{tmp_path}/store4")
    with pytest.raises(ValueError):
        production.Rules(channel_hectares=0.1)
    with pytest.raises(ValueError):
        production.Purity("a", "b", none=0.7)


def test_water_that_flows_in_makes_a_channel(spark):
    """A valley that begins outside the map: only with the margin is there a channel inside."""
    relief = raster.grid_pixels(spark, 60, 21).select((F.col("row") - 40).alias("row"), "col", (500.0 - F.col("row") * 2 + F.abs(F.col("col") - 10) * 3).alias("z"))
    inside = relief.where("row >= 0")
    first = inside.select("row", "col", F.lit(1).alias("code"), F.lit(False).alias("candidate"))
    rules = production.Rules(channel_hectares=4.0)
    settings = lambda dem: production.with_settings(first, Grid(0.0, 0.0, 10.0), rules, None, production.channel_pixels(dem, 4.0, 10.0)).where("setting = 1").count()
    assert settings(inside) < settings(relief)


def scans(frame):
    """Leaves of the plan."""
    return frame._jdf.queryExecution().optimizedPlan().collectLeaves().size()


def test_settings_meet_stored_distances(spark):
    """The plan that joins all reads each table once: the pixels, their water and three distances."""
    pixels = saved(raster.grid_pixels(spark, 40, 20).withColumns({"code": F.lit(1), "candidate": F.col("row") < 4}), "pixels")
    lakes = spark.createDataFrame([(55.0, -105.0)], "x double, y double")
    got = production.with_settings(pixels, Grid(0.0, 0.0, 10.0), production.Rules(), lakes, pixels.where("row = 30").select("row", "col"))
    assert scans(got) == 5
    for r in got.collect():
        assert r.d_water == max(0, r.row - 3) * 10 and r.d_channel == abs(r.row - 30) * 10 and abs(r.d_lake - 10 * math.dist((r.row, r.col), (10, 5))) < 1e-9
    bare = production.with_settings(pixels, Grid(0.0, 0.0, 10.0), production.Rules())
    assert bare.count() == 800 and bare.where("d_lake is not null or d_channel is not null").isEmpty()


def test_stored_blocks_forget_how_they_were_wanted(spark, tmp_path):
    """What the second phase reads: the pixels and their blocks, whatever the blocks and the zone came from; the settings and the purity read them once each."""
    wanted = spark.range(6).select((F.col("id") % 3).cast("int").alias("block_row"), F.lit(0).alias("block_col"))
    wanted = wanted.join(wanted.distinct(), ["block_row", "block_col"]).union(wanted)
    pixels = raster.grid_pixels(spark, 700, 3).withColumns({"block_row": raster.block_of()[0], "block_col": raster.block_of()[1], "code": F.lit(1), "p_max": F.lit(0.9), "candidate": F.col("row") < 4, "green": F.lit(0.5), "wet": F.col("row") == 300})
    first = mapping.cached_blocks(wanted, lambda blocks: pixels.join(blocks, ["block_row", "block_col"], "left_semi"), f"file://{tmp_path}/store", "k")
    assert scans(first) == 2 and first.count() == 2100
    done = production.second_phase(first, Grid(0.0, 0.0, 10.0), production.Rules(), 1, purity=production.Purity("green", "wet"))
    assert scans(done) <= 6  # pixels and their blocks for the map and for wet ones, water, its distance
    assert {(r.purity, r.n) for r in done.groupBy("purity").agg(F.count("*").alias("n")).collect()} == {("mixed-water", 9), ("mixed-rock", 2091)}
