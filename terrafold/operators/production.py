"""The map producer: a model over the pixels of a zone, block by block, and then what only the whole map can tell.

First phase: blocks are read and predicted where the zone allows and every predictor has a value (a map imputes nothing); each commit of
blocks is stored with the list of its blocks, so a run that failed goes on where it stopped. Second phase: patches of open water,
distances to water, lakes and channels, the setting of each pixel and its composed class, and purity. The map is committed whole or not at all.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.operators import decisions, hydrology, raster, review
from terrafold.operators.distance import distance_transform, point_distance
from terrafold.operators.mapping import branch_and_leaf, cached_blocks, classify, composed, reading_key, write_map
from terrafold.operators.training import Bundle, predict
from terrafold.operators.zones import Grid, Zone, in_runs, run_area
from terrafold.sources.tables import saved, spread

#: Settings in the order of their codes, which make the branches of composed classes.
SETTINGS = ("stream", "lake", "slope")


# The ranges within which a rule may lie.
LIMITS = {"water": (0.0, 1000.0), "lake": (0.0, 1000.0), "channel": (0.0, 500.0), "channel_hectares": (0.5, 500.0)}


@dataclass(frozen=True)
class Rules:
    """What decides a pixel's class beside its probabilities. Distances in metres; limits are inside."""

    threshold: float | None = None
    water: float = 100.0
    lake: float = 120.0
    channel: float = 30.0
    channel_hectares: float = 8.0
    reach: float = 1000.0
    margin: float = 1000.0
    least_water: int = 3
    remove_water: bool = False

    def __post_init__(self) -> None:
        if self.threshold is not None and not 0 < self.threshold < 1:
            raise ValueError("threshold: between 0 and 1")
        for name, (low, high) in LIMITS.items():
            if not low <= getattr(self, name) <= high:  # NaN is outside too
                raise ValueError(f"{name}: between {low:g} and {high:g}")
        if max(self.water, self.lake) > self.reach or self.least_water < 1:
            raise ValueError("the reach of points covers the limits of water and lakes, and a patch has a pixel at least")


@dataclass(frozen=True)
class Purity:
    """Columns of early green and of water, and the green of bare and of full cover, and from which share a pixel is pure."""

    green: str
    water: str
    none: float = 0.08
    full: float = 0.60
    pure_from: float = 0.75

    def __post_init__(self) -> None:
        if not -0.5 <= self.none < self.full <= 1 or not 0 < self.pure_from <= 1:
            raise ValueError("purity: -0.5 <= none < full <= 1 and 0 < pure_from <= 1")


def predicted_pixels(model: Bundle, pixels: DataFrame, allowed: Column, threshold: float | None, with_absence: bool, ndwi: str | None = None, slope: str | None = None, purity: Purity | None = None) -> DataFrame:
    """``row, col`` with ``code, p_max, p_meadow, probabilities``, null where a predictor is missing or the pixel is not allowed,
    and what the second phase needs: ``candidate`` (may be open water), ``green`` and ``wet``."""
    done = classify(predict(model, pixels), list(model.predictors), F.col("probabilities"), allowed, threshold, with_absence)
    valid = F.col("code").isNotNull()
    candidate = raster.flag_water(F.col(ndwi).cast("float"), F.col(slope).cast("float")) if ndwi else F.lit(False)
    green = review.green_share(F.col(purity.green), purity.none, purity.full) if purity else F.lit(None).cast("float")
    wet = F.coalesce(F.col(purity.water).cast("float") > 0, F.lit(False)) if purity else F.lit(False)
    return done.select(
        "row", "col", *raster.block_of(), "code", "p_max", "p_meadow", F.when(valid, F.transform("probabilities", lambda p: p.cast("float"))).alias("probabilities"),
        candidate.alias("candidate"), F.when(valid, green).alias("green"), wet.alias("wet"), allowed.alias("allowed"))


def lake_water(first: DataFrame, least: int) -> DataFrame:
    """``row, col`` of open water: candidates in patches of at least so many pixels, wherever blocks end."""
    return raster.patches(first.where("candidate").select("row", "col"), least).select("row", "col")


def channel_pixels(relief: DataFrame, hectares: float, cell: float) -> DataFrame:
    """``row, col`` of the pixels through which so many hectares drain. The relief may reach beyond the map: what flows in from there counts."""
    level = hydrology.filled(relief, 1e-9)
    return hydrology.channels(hydrology.accumulation(hydrology.receivers(level, cell), cell), hectares)


def with_settings(first: DataFrame, grid: Grid, rules: Rules, lakes: DataFrame | None = None, channels: DataFrame | None = None) -> DataFrame:
    """``first`` (row, col, code, candidate, ...) with ``lake_water, d_water, d_lake, d_channel, setting`` (its code).

    ``lakes``: points x, y. ``channels``: pixels row, col, which may lie off the map; both count from wherever they are.
    Each distance is stored before the pixels meet it: in one plan the driver would hold all of them, and send that plan's counters with every task.
    """
    place = first.select("row", "col")
    water = saved(lake_water(first, rules.least_water), "lake-water")
    out = first.join(spread(water.withColumn("lake_water", F.lit(True))), ["row", "col"], "left").withColumn("lake_water", F.coalesce("lake_water", F.lit(False)))
    near = point_distance(place, lakes, grid, rules.reach) if lakes is not None else None
    for name, part in (("d_water", distance_transform(place, water, grid.cell)), ("d_lake", near), ("d_channel", distance_transform(place, channels, grid.cell) if channels is not None else None)):
        out = out.withColumn(name, F.lit(None).cast("double")) if part is None else out.join(spread(saved(part.withColumnRenamed("d", name), name)), ["row", "col"])
    name = decisions.proximity_setting(F.col("d_water"), F.col("d_lake"), F.col("d_channel"), rules.water, rules.lake, rules.channel)
    return out.withColumn("setting", F.array_position(F.array(*map(F.lit, SETTINGS)), name).cast("int"))


def without_open_water(first: DataFrame, with_absence: bool = True) -> DataFrame:
    """Open water of a lake is no meadow: the class becomes absence, and the probability of the class that of absence."""
    if not with_absence:
        return first
    goes = F.col("lake_water") & (F.col("code") > 0)
    return first.withColumns({"p_max": F.when(goes, F.element_at("probabilities", 1)).otherwise(F.col("p_max")), "green": F.when(~F.coalesce(goes, F.lit(False)), F.col("green")), "code": F.when(goes, F.lit(0)).otherwise(F.col("code"))})


def with_purity(pixels: DataFrame, pure_from: float, first: DataFrame | None = None) -> DataFrame:
    """``purity`` of meadow pixels: pure from that share of green on; else mixed with water at or next to water, or with rock.

    ``first`` has the same pixels with ``wet`` from a shorter plan, if there is one.
    """
    near = raster.dilate((pixels if first is None else first).where("wet")).withColumn("by_water_", F.lit(True))
    out = pixels.join(spread(near), ["row", "col"], "left")
    kind = F.when(F.col("green") >= F.lit(pure_from).cast("float"), F.lit("pure")).when(F.col("by_water_"), F.lit("mixed-water")).otherwise(F.lit("mixed-rock"))
    return out.withColumn("purity", F.when((F.col("code") > 0) & F.col("green").isNotNull(), kind)).drop("by_water_")


def second_phase(first: DataFrame, grid: Grid, rules: Rules, n_types: int, lakes: DataFrame | None = None, channels: DataFrame | None = None, with_absence: bool = True, purity: Purity | None = None) -> DataFrame:
    """The whole map from all predicted pixels. ``class``: setting and type of the pixel composed, 0 for absence."""
    out = with_settings(first, grid, rules, lakes, channels)
    if rules.remove_water:
        out = without_open_water(out, with_absence)
    out = with_purity(out, purity.pure_from, first) if purity else out.withColumn("purity", F.lit(None).cast("string"))
    leaf = F.col("code")
    return out.withColumn("class", F.when(leaf.isNotNull(), composed(F.col("setting"), leaf, n_types)))


def summary(mapped: DataFrame, classes: list[str], cell: float) -> dict:
    """Pixels and hectares of each class and setting of meadows, of purity, and the mean probability."""
    n_types, hectares = len(classes) - 1, cell * cell / 10_000
    counts = mapped.groupBy("class", "purity").agg(F.count(F.lit(1)).alias("n"), F.count_if("allowed").alias("n_allowed"), F.sum(F.col("p_max").cast("double")).alias("p"), F.count_if("lake_water").alias("n_water")).collect()  # classes by purities
    names = {0: classes[0]} | {b * n_types + t: f"{setting} {classes[t]}" for b, setting in enumerate(SETTINGS) for t in range(1, n_types + 1)}
    by = lambda key, name: {"name": name, "pixels": sum(r.n for r in counts if key(r)), "hectares": round(sum(r.n for r in counts if key(r)) * hectares, 2)}
    seen = sum(r.n for r in counts if r["class"] is not None)
    return {
        "classes": [{"code": k, **by(lambda r, k=k: r["class"] == k, name)} for k, name in names.items()],
        "settings": [by(lambda r, b=b: r["class"] and (r["class"] - 1) // n_types == b, name) for b, name in enumerate(SETTINGS)],
        "purity": [by(lambda r, k=k: r["purity"] == k, k) for k in ("pure", "mixed-water", "mixed-rock")],
        "pixels_classified": seen, "pixels_in_zone": sum(r.n_allowed for r in counts), "pixels_without_predictors": sum(r.n_allowed for r in counts) - seen,
        "pixels_of_lake_water": sum(r.n_water for r in counts), "mean_probability": round(sum(r.p or 0 for r in counts) / seen, 6) if seen else None}


def first_phase(model: Bundle, read: Callable[[DataFrame], DataFrame], bands: list[str], zone: Zone, store: str, key: str, threshold: float | None, with_absence: bool, ndwi: str | None, slope: str | None, purity: Purity | None) -> DataFrame:
    """The predicted pixels of the zone's useful blocks, from the store where they are there already."""
    if lost := [b for b in model.predictors if b not in bands]:
        raise ValueError(f"bands that the model needs: {', '.join(lost)}")
    size = 256
    blocks = zone.runs.select(F.floor(F.col("row") / size).cast("int").alias("block_row"), F.explode(F.sequence(F.floor(F.col("col_from") / size).cast("int"), F.floor(F.col("col_to") / size).cast("int"))).alias("block_col")).distinct()

    def compute(missing: DataFrame) -> DataFrame:
        pixels = read(missing).select("row", "col", *bands)
        return predicted_pixels(model, in_runs(pixels, zone.runs), F.col("inside"), threshold, with_absence, ndwi, slope, purity)

    return cached_blocks(blocks, compute, store, key)


def produce_map(model: Bundle, about: dict, read: Callable[[DataFrame], DataFrame], bands: list[str], zone: Zone, path: str, store: str, rules: Rules = Rules(), lakes: DataFrame | None = None,
                relief: DataFrame | None = None, channels: DataFrame | None = None, ndwi: str | None = None, slope: str | None = None, purity: Purity | None = None, extra: dict | None = None) -> dict:
    """Map a zone with a model (and its description ``about``), commit it to ``path`` and return its description.

    ``read`` takes blocks (block_row, block_col) and returns their pixels with ``bands``. ``relief`` (row, col, z on the zone's grid, with a margin around
    if there is one) gives the channels, unless ``channels`` do. ``store`` keeps the first phase by block. Errors: a zone with a problem, and
    a model whose classes do not fit; a failure leaves no map.
    """
    if zone.problem:
        raise ValueError(zone.problem)
    classes, with_absence = list(about["classes"]), about.get("absence", True)
    if model.forest.numClasses != len(classes):
        raise ValueError("the classes of the model are not those of its description")
    if rules.remove_water and not (ndwi and slope):
        raise ValueError("open water needs the bands of water and slope")
    zone = replace(zone, runs=saved(zone.runs, "zone-runs"))
    key = reading_key(classes=classes, forest=model.forest.uid, medians=model.medians, grid=asdict(zone.grid), bands=bands, threshold=rules.threshold, purity=None if purity is None else asdict(purity))
    first = first_phase(model, read, bands, zone, store, key, rules.threshold, with_absence, ndwi, slope, purity)
    if relief is not None and channels is None:
        channels = saved(channel_pixels(relief, rules.channel_hectares, zone.grid.cell), "channels")
    names = classes if with_absence else ["absence", *classes]
    mapped = saved(second_phase(first, zone.grid, rules, len(names) - 1, lakes, channels, with_absence, purity).drop("block_row", "block_col"), "map")
    told = {"grid": asdict(zone.grid), "rules": asdict(rules), "predictors": list(model.predictors), "blocks": zone.blocks, "key": key, "zone": run_area(zone.runs, zone.grid.cell).first().asDict(),
            **summary(mapped, names, zone.grid.cell), **(extra or {})}
    write_map(mapped, path, told)
    return told


def map_branches(classes: DataFrame, n_types: int) -> DataFrame:
    """``class`` codes with the code of their setting and of their type."""
    branch, leaf = branch_and_leaf(F.col("class"), n_types)
    return classes.withColumns({"setting": branch, "type": leaf})
