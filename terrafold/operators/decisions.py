"""Rules that turn a probability and a label into a decision, and typology by rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.operators.quantiles import column_quantiles

PROBABLE, NEVER = 0.70, 0.20


def decide(proba: Column, label: Column, doubtful: Column, threshold: Column | float = 0.5) -> Column:
    """Doubt first, then the known label, then the probability; a high probability is never demoted by the threshold."""
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return (
        F.when(F.coalesce(doubtful, F.lit(False)), F.lit("DOUBTFUL")).when(label == "yes", F.lit("VERIFIED_YES")).when(label == "no", F.lit("VERIFIED_NO"))
        .when(proba.isNull(), F.lit("NO_DATA")).when(proba >= PROBABLE, F.lit("PROBABLE")).when(proba >= t, F.lit("POSSIBLE"))
        .when(proba <= NEVER, F.lit("NO")).otherwise(F.lit("UNCERTAIN")))


def decision_counts(rows: DataFrame, decision: str = "decision") -> DataFrame:
    return rows.groupBy(decision).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), decision)


def setting(lake_m: Column, ndwi: Column, water_albedo: Column, stream_m: Column, twi: Column, slope: Column) -> Column:
    """Lake near a lake or with the signature of water, stream by distance, wetness index or flat ground, else slope."""
    return (
        F.when(lake_m < 120, F.lit("lake")).when((ndwi > 0.05) & (water_albedo < 0.12), F.lit("lake"))
        .when(stream_m < 30, F.lit("stream")).when(twi > 6.5, F.lit("stream")).when(slope < 7, F.lit("stream"))
        .when(slope >= 7, F.lit("slope")).otherwise(F.lit("-")))


def wetness(ndmi: Column, twi: Column) -> Column:
    return F.when(ndmi > 0.10, F.lit("wet")).when(ndmi.isNotNull(), F.lit("dry")).when(twi > 7, F.lit("wet")).when(twi.isNotNull(), F.lit("dry")).otherwise(F.lit("-"))


def proximity_setting(water_m: Column, lake_m: Column, channel_m: Column, water: float = 100, lake: float = 120, channel: float = 30) -> Column:
    """Setting by distances; null means nothing near, limits are inside, and both sides compare as floats."""
    near = lambda d, limit: F.coalesce(d.cast("float") <= F.lit(limit).cast("float"), F.lit(False))
    return F.when(near(water_m, water) | near(lake_m, lake), F.lit("lake")).when(near(channel_m, channel), F.lit("stream")).otherwise(F.lit("slope"))


def purity_by_population(rows: DataFrame, green: str, albedo: str, water: str, high: float = 0.85, low: float = 0.15, least: int = 5) -> DataFrame:
    """Purity against percentiles of the rows themselves; with fewer than ``least`` values there is no cut."""
    cuts = column_quantiles(rows, {"green_cut": (green, low), "rock_cut": (albedo, high), "water_cut": (water, high)}, least)
    out = rows.crossJoin(F.broadcast(cuts))  # one row
    return out.withColumn("purity", F.when((F.col(water) >= F.col("water_cut")) & (F.col(green) <= F.col("green_cut")), F.lit("mixed-water"))
                          .when((F.col(albedo) >= F.col("rock_cut")) & (F.col(green) <= F.col("green_cut")), F.lit("mixed-rock")).otherwise(F.lit("pure")))


def with_review(rows: DataFrame, levels: dict[str, tuple[str, ...]]) -> DataFrame:
    """``<level>_rule`` keeps the proposal; a valid reviewed value in ``<level>_reviewed`` wins, an invalid one is reported."""
    for level, valid in levels.items():
        reviewed = F.col(f"{level}_reviewed")
        good = reviewed.isin(*valid)
        rows = rows.withColumns({f"{level}_rule": F.col(level), f"{level}_invalid": reviewed.isNotNull() & ~good, level: F.when(good, reviewed).otherwise(F.col(level))})
    return rows


def two_step(types: Column, absence: Column, threshold: Column | float | None) -> Column:
    """Class 0 (absence) or the most likely type, 1 the first; the lowest of equals wins.

    Without a threshold a tie with absence is absence; with one, the types' summed probability must reach it.
    """
    total = F.aggregate(types, F.lit(0.0).cast("float"), lambda a, p: (a + p.cast("float")).cast("float"))
    best = F.array_max(types)
    kind = F.array_position(types, best).cast("int")
    if threshold is None:
        return F.when(best > absence, kind).otherwise(F.lit(0))
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return F.when(total >= t.cast("float"), kind).otherwise(F.lit(0))


def purity(green: Column, cut: Column | float, by_water: Column) -> Column:
    """Pure at or above the cut of greenness, else mixed with water where water is next to it, else with rock."""
    c = cut if isinstance(cut, Column) else F.lit(cut)
    return F.when(green >= c, F.lit("pure")).when(F.coalesce(by_water, F.lit(False)), F.lit("mixed-water")).when(green.isNotNull(), F.lit("mixed-rock"))


def median_or(rows: DataFrame, value: str, least: int = 5, default: float = 0.60) -> DataFrame:
    """The median of a column, or the default with fewer than ``least`` values."""
    return column_quantiles(rows, {"cut": (value, 0.5)}, least).select(F.coalesce("cut", F.lit(default)).alias("cut"))


def water_override(code: Column, best: Column, absent: Column, water: Column) -> tuple[Column, Column]:
    """Class and its probability; open water is absence, with the probability of absence."""
    over = F.coalesce(water, F.lit(False)) & (code != 0)
    return F.when(over, F.lit(0)).otherwise(code), F.when(over, absent).otherwise(best)


def review_summary(rows: DataFrame, levels: list[str]) -> DataFrame:
    """For each level how many rows were reviewed, and how many of those differ from the rule."""
    each = F.array(*[F.struct(F.lit(x).alias("level"), F.col(f"{x}_reviewed").alias("reviewed"), F.col(f"{x}_rule").alias("rule")) for x in levels])
    return rows.select(F.inline(each)).groupBy("level").agg(
        F.count("reviewed").alias("reviewed"), F.count_if(F.col("reviewed").isNotNull() & (F.col("reviewed") != F.col("rule"))).alias("corrected"))
