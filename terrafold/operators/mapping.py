"""From pixels and a model's probabilities to a map: masks, classes, areas, and a committed copy by block."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.operators.raster import block_of
from terrafold.operators.zones import Grid, in_runs, zone_runs
from terrafold.sources.tables import saved

NO_DATA = -9999.0


def estimated_minutes(blocks: DataFrame, fixed: float = 20.0, per_pixel: float = 0.0008) -> DataFrame:
    """Minutes that reading the blocks takes: a fixed time each, and a time a pixel."""
    return blocks.agg((F.sum(fixed + per_pixel * F.col("width") * F.col("height")) / 60).alias("minutes"))


def zone_mask(pixels: DataFrame, edges: DataFrame, grid: Grid) -> DataFrame:
    """``row, col, inside``: whether the centre of each pixel of the grid lies in a polygon."""
    return in_runs(pixels.select("row", "col"), zone_runs(edges, grid)).select("row", "col", "inside")


def read_blocks(pixels: DataFrame, bands: list[str], size: int = 256) -> DataFrame:
    """The asked bands in their order as float, with the block of each pixel; the sentinel becomes null."""
    value = lambda b: F.nullif(F.col(b).cast("float"), F.lit(NO_DATA).cast("float")).alias(b)
    if lost := [b for b in bands if b not in pixels.columns]:
        raise ValueError(f"bands that are not there: {', '.join(lost)}")
    return pixels.select(*block_of(size), "row", "col", *[value(b) for b in bands])


def for_sink(pixels: DataFrame, bands: list[str]) -> DataFrame:
    """Bands as float with the sentinel for null, as files without null have them."""
    return pixels.withColumns({b: F.coalesce(F.col(b).cast("float"), F.lit(NO_DATA).cast("float")) for b in bands})


def split_probabilities(probabilities: Column, with_absence: bool = True) -> tuple[Column, Column, Column, Column]:
    """Of an array of class probabilities: that of any type, the likeliest type (the first of equals), its own, and that of absence.

    Everything is added and compared as float, the way it is stored. With absence, class 0 is the first element.
    """
    p = F.transform(probabilities, lambda x: x.cast("float"))
    types = F.slice(p, 2, F.size(p) - 1) if with_absence else p
    total = F.aggregate(types, F.lit(0.0).cast("float"), lambda a, x: (a + x).cast("float"))
    best = F.array_max(types)
    return total, F.array_position(types, best).cast("int"), best, (F.element_at(p, 1) if with_absence else F.lit(None).cast("float"))


def classify(pixels: DataFrame, features: list[str], probabilities: Column, allowed: Column | None = None, threshold: float | None = None, with_absence: bool = True) -> DataFrame:
    """``code, p_max, p_meadow`` for each pixel; null where a feature is missing or the pixel is not allowed.

    With a threshold, types need that much in sum; without, the likeliest type must exceed absence. A model without
    absence gives its likeliest type.
    """
    valid = F.lit(True)
    for f in features:
        valid = valid & F.col(f).isNotNull() & ~F.isnan(F.col(f))
    if allowed is not None:
        valid = valid & F.coalesce(allowed, F.lit(False))
    # Each step is a column of its own, so that no array is made again for every use of it.
    told = pixels.withColumn("valid_", valid)
    told = told.withColumn("shares_", F.when(F.col("valid_"), F.transform(probabilities, lambda x: x.cast("float"))))
    told = told.withColumn("types_", F.slice("shares_", 2, F.size("shares_") - 1) if with_absence else F.col("shares_"))
    told = told.withColumns({"total_": F.aggregate("types_", F.lit(0.0).cast("float"), lambda a, x: (a + x).cast("float")), "best_": F.array_max("types_"), "absent_": F.element_at("shares_", 1) if with_absence else F.lit(None).cast("float")})
    total, best, absent = F.col("total_"), F.col("best_"), F.col("absent_")
    is_type = F.lit(True) if not with_absence else best > absent if threshold is None else total >= F.lit(threshold).cast("float")
    kind = F.array_position("types_", best).cast("int")
    done = told.withColumns({
        "code": F.when(F.col("valid_"), F.when(is_type, kind).otherwise(F.lit(0))), "p_max": F.when(F.col("valid_"), F.when(is_type, best).otherwise(absent)), "p_meadow": F.when(F.col("valid_"), total)})
    return done.drop("valid_", "shares_", "types_", "total_", "best_", "absent_")


def combined(meadow: Column, types: Column) -> Column:
    """Class probabilities of two models on one pixel: absence, and each type given a meadow."""
    return F.concat(F.array((1 - meadow).cast("float")), F.transform(types, lambda t: (meadow * t).cast("float")))


def composed(branch: Column, leaf: Column, n_leaves: int) -> Column:
    """Code of a class made of two: branches of n leaves each; leaf 0 stays 0, and a leaf out of range has no code."""
    good = (leaf >= 1) & (leaf <= n_leaves) & (branch >= 1)
    return F.when(leaf == 0, F.lit(0)).when(good, (branch - 1) * n_leaves + leaf).cast("int")


def branch_and_leaf(code: Column, n_leaves: int) -> tuple[Column, Column]:
    return (F.when(code > 0, F.floor((code - 1) / n_leaves) + 1).otherwise(F.lit(0)).cast("int"), F.when(code > 0, (code - 1) % n_leaves + 1).otherwise(F.lit(0)).cast("int"))


def map_areas(pixels: DataFrame, code: str, classes: DataFrame, cell: float, n_leaves: int) -> DataFrame:
    """A row for every class of the catalogue (code, name), one for each branch and one for no data: pixels and hectares."""
    counts = pixels.groupBy(F.col(code).alias("code")).agg(F.count(F.lit(1)).alias("n"))
    named = classes.join(counts, "code", "left").select(F.lit("class").alias("kind"), "name", F.coalesce("n", F.lit(0)).alias("pixels"))
    branch, _ = branch_and_leaf(F.col("code"), n_leaves)
    branches = counts.where("code > 0").groupBy(branch.alias("b")).agg(F.sum("n").alias("pixels")).select(F.lit("branch").alias("kind"), F.col("b").cast("string").alias("name"), "pixels")
    nothing = counts.agg(F.coalesce(F.sum(F.when(F.col("code").isNull(), F.col("n"))), F.lit(0)).alias("pixels")).select(F.lit("no data").alias("kind"), F.lit("").alias("name"), "pixels")
    return named.union(branches).union(nothing).withColumn("hectares", F.col("pixels") * (cell * cell / 10000))


def _path(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def write_map(pixels: DataFrame, path: str, about: dict, size: int = 256) -> None:
    """Pixels by rows of blocks, and then the description, whose presence says that the map is whole. A failure leaves nothing."""
    spark = pixels.sparkSession
    target, files = _path(spark, path)
    if files.exists(target):
        raise FileExistsError(path)
    try:
        row, col = block_of(size)
        pixels.withColumns({"block_row": row, "block_col": col}).repartition("block_row", "block_col").write.partitionBy("block_row").parquet(f"{path}/pixels")
        place, _ = _path(spark, f"{path}/map.json")
        out = files.create(place, False)
        out.write(bytearray(json.dumps(about, sort_keys=True).encode()))
        out.close()
    except BaseException:
        files.delete(target, True)
        raise


def read_map(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """Pixels and description of a whole map."""
    place, files = _path(spark, f"{path}/map.json")
    if not files.exists(place):
        raise FileNotFoundError(f"{path}: no map, or one that was not finished")
    return spark.read.parquet(f"{path}/pixels"), json.loads(spark.read.text(f"{path}/map.json", wholetext=True).first()[0])


def reading_key(**parts) -> str:
    """A name for a reading: equal where everything that it depends on is equal."""
    return hashlib.md5(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()


def cached_blocks(wanted: DataFrame, compute, path: str, key: str) -> DataFrame:
    """The pixels of the wanted blocks (block_row, block_col), from the cache of this key; what is missing is computed and added.

    ``compute`` takes the missing blocks and returns pixels with block_row and block_col. Pixels are written under the name of
    their commit, and then, in one file, the list of its blocks, empty ones included: a commit without a list does not count, so a failed one
    is computed again, and a block that two runs added is read from one of them.
    """
    spark, place = wanted.sparkSession, f"{path}/read={key}"
    target, files = _path(spark, f"{place}/blocks")
    known = lambda: spark.read.schema("block_row int, block_col int, commit string").parquet(f"{place}/blocks").groupBy("block_row", "block_col").agg(F.min("commit").alias("commit"))
    wanted = missing = saved(wanted.select("block_row", "block_col").distinct(), "wanted-blocks")
    if files.exists(target):
        missing = saved(missing.join(known(), ["block_row", "block_col"], "left_anti"), "missing-blocks")
    if not missing.isEmpty():
        commit = uuid.uuid4().hex
        compute(missing).withColumn("commit", F.lit(commit)).repartition("block_row", "block_col").write.mode("append").partitionBy("commit").parquet(f"{place}/pixels")
        missing.withColumn("commit", F.lit(commit)).coalesce(1).write.mode("append").parquet(f"{place}/blocks")
    pixels = spark.read.parquet(f"{place}/pixels")
    own = saved(known().join(wanted, ["block_row", "block_col"]), "own-blocks")
    return pixels.withColumn("commit", F.col("commit").cast("string")).join(own, ["block_row", "block_col", "commit"]).drop("commit")


def signature(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: a signature of the multiset of rows, whatever their order. Equal tables have equal signatures.

    The first 48 bits of each row's MD5 are added up, so nothing is gathered or sorted.
    """
    told = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns])
    number = F.conv(F.substring(F.md5(told), 1, 12), 16, 10).cast("decimal(20,0)")
    total = F.coalesce(F.sum(number), F.lit(0).cast("decimal(30,0)")).cast("decimal(30,0)").cast("string")
    return rows.agg(F.md5(F.concat_ws("|", F.lit(",".join(columns)), F.count(F.lit(1)).cast("string"), total)).alias("signature"))
