"""From scene observations to per-point features.

``obs`` has point_id, ts, year, season and band columns; a masked or invalid band is null, never NaN.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: First and last month-day of the early and the late season.
SEASONS = {"early": ("06-15", "07-25"), "late": ("08-01", "09-30")}


def season(ts: Column) -> Column:
    day = F.date_format(ts, "MM-dd")
    out = F.lit(None).cast("string")
    for name, (first, last) in SEASONS.items():
        out = F.when(day.between(first, last), F.lit(name)).otherwise(out)
    return out


def median_of_yearly_medians(obs: DataFrame, values: list[str], by: list[str] = ["point_id", "season"]) -> DataFrame:
    """Median over scenes of a year, then over years."""
    yearly = obs.groupBy(*by, "year").agg(*[F.median(v).alias(v) for v in values])
    return yearly.groupBy(*by).agg(*[F.median(v).alias(v) for v in values])


def pooled_stats(obs: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Mean, extremes and population deviation over all scenes."""
    return obs.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), F.stddev_pop(value).alias("sd"))


def yearly_stats(obs: DataFrame, value: str, by: list[str], least: int = 2) -> DataFrame:
    """The same for each year, then the mean of each over years; a deviation needs ``least`` scenes in its year."""
    yearly = obs.groupBy(*by, "year").agg(
        F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"),
        F.when(F.count(value) >= least, F.stddev_pop(value)).alias("sd"))
    return yearly.groupBy(*by).agg(*[F.avg(c).alias(c) for c in ("mean", "min", "max", "sd")], F.count(F.lit(1)).alias("years"))


def composite(obs: DataFrame, bands: list[str], by: list[str]) -> DataFrame:
    """Median reflectance of each band; indices are taken from the composite."""
    return obs.groupBy(*by).agg(*[F.median(b).alias(b) for b in bands])


def first_valid(obs: DataFrame, valid: Column, by: list[str], order: list[Column | str], most: int) -> DataFrame:
    """The first ``most`` valid scenes of each group, in order of arrival."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return obs.where(valid).withColumn("rank", rank).where(F.col("rank") <= most)


def window_votes(pixels: DataFrame, by: list[str], clear: Column, least_share: float = 0.5) -> DataFrame:
    """Groups of window pixels of which at least a share is clear, with the number of valid ones."""
    seen = pixels.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(clear).alias("n_clear"))
    return seen.where(F.col("n_clear") >= least_share * F.col("n"))


def interval_mean(left: DataFrame, right: DataFrame, key: str, ts: str, value: str, days: int = 1) -> DataFrame:
    """Each left row with the mean of the right rows of its key within ``days`` of its time.

    The times are put into buckets of that length, and each right row is joined from its own bucket and both
    neighbours: an equi-join, which shuffles, instead of a range condition over a whole key.
    """
    width = days * 86400
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    bucketed = left.withColumn("bucket_", F.floor(seconds(ts) / width)).withColumn("row_", F.monotonically_increasing_id())
    near = right.select(F.col(key), F.col(ts).alias("other_ts"), F.col(value).alias("other"), F.explode(F.array(*[F.floor(seconds(ts) / width) + d for d in (-1, 0, 1)])).alias("bucket_"))
    step = F.expr(f"INTERVAL {days} DAY")
    found = bucketed.join(near, [key, "bucket_"], "left")
    inside = F.when(F.col("other_ts").between(F.col(ts) - step, F.col(ts) + step), F.col("other"))
    return found.groupBy("row_", *left.columns).agg(F.avg(inside).alias("near_mean"), F.count(inside).alias("near_n")).drop("row_")


def best_day(readings: DataFrame, by: list[str], day: str, score: list[Column]) -> DataFrame:
    """The day with the best score; the earliest of equals."""
    order = Window.partitionBy(*by).orderBy(*[s.desc() for s in score], F.col(day))
    return readings.withColumn("rank_", F.row_number().over(order)).where("rank_ = 1").drop("rank_")


def backscatter(windows: DataFrame, by: list[str], power: str) -> DataFrame:
    """Mean power of a window in decibel for each scene, then mean and population deviation over scenes."""
    scenes = windows.groupBy(*by, "scene_id").agg(F.avg(F.when(F.col(power) > 0, F.col(power))).alias("p")).withColumn("db", 10 * F.log10("p"))
    return scenes.groupBy(*by).agg(F.avg("db").alias("db_mean"), F.stddev_pop("db").alias("db_sd"))


def best_covered(points: DataFrame, scenes: DataFrame, cell: float) -> DataFrame:
    """``day, covered, cloud`` of the day whose scenes' boxes (x0, x1, y0, y1) hold most points; of equals the least cloudy,
    then the first. A box goes to the cells it spans and a point to its own."""
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell)))
    boxes = scenes.withColumn("cx", span("x0", "x1")).withColumn("cy", span("y0", "y1"))
    met = boxes.join(points.select("from_id", "x", "y", F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy")), ["cx", "cy"])
    held = met.where((F.col("x") >= F.col("x0")) & (F.col("x") <= F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") <= F.col("y1")))
    covered = held.select("day", "from_id").distinct().groupBy("day").agg(F.count(F.lit(1)).alias("covered"))
    days = scenes.groupBy("day").agg(F.avg("cloud").alias("cloud")).join(covered, "day", "left").withColumn("covered", F.coalesce("covered", F.lit(0)))
    return days.orderBy(F.desc("covered"), F.round("cloud", 9), "day").limit(1).select("day", "covered", "cloud")


def polarisation(vv: DataFrame, vh: DataFrame, by: list[str]) -> DataFrame:
    """Statistics of both polarisations, and the difference of their means in decibel."""
    a = backscatter(vv, by, "power").select(*by, F.col("db_mean").alias("vv_mean"), F.col("db_sd").alias("vv_sd"))
    b = backscatter(vh, by, "power").select(*by, F.col("db_mean").alias("vh_mean"), F.col("db_sd").alias("vh_sd"))
    return a.join(b, by, "full").withColumn("ratio", F.col("vv_mean") - F.col("vh_mean"))


def best_readings(readings: DataFrame, by: list[str], value: str, least: int = 2) -> DataFrame:
    """Of each day the reading with most valid pixels (the first of equals); over days their mean, 10th percentile and
    deviation, which needs ``least`` days. ``readings`` has day, reading, n_valid."""
    best = readings.where(F.col(value).isNotNull()).groupBy(*by, "day").agg(F.min_by(value, F.struct(-F.col("n_valid"), F.col("reading"))).alias("v"))
    return best.groupBy(*by).agg(F.count("v").alias("days"), F.avg("v").alias("mean"), F.percentile("v", F.lit(0.1)).alias("p10"), F.when(F.count("v") >= least, F.stddev_pop("v")).alias("sd"))


def in_windows(rows: DataFrame, ts: str, windows: list[tuple[str, str]]) -> DataFrame:
    """Rows within any of the windows (first day, last day inclusive): one predicate, which reaches the scan."""
    keep = F.lit(False)
    for first, last in windows:
        keep = keep | ((F.col(ts) >= F.lit(first).cast("timestamp")) & (F.col(ts) < F.date_add(F.lit(last).cast("date"), 1).cast("timestamp")))
    return rows.where(keep)
