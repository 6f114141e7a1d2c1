"""Quantile profiles of classes, and where points lie in them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.operators.quantiles import exact_quantiles

QUANTILES = (0.10, 0.25, 0.50, 0.75, 0.90)


def unpivoted(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    each = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("value")) for c in columns])
    return rows.select(*keys, F.inline(each)).where("value is not null")


def class_percentiles(rows: DataFrame, code: str, columns: list[str], least: int = 10) -> DataFrame:
    """Exact percentiles of each variable in each class with enough values."""
    stats = exact_quantiles(unpivoted(rows, [code], columns), [code, "variable"], "value", {f"p{round(q * 100)}": q for q in QUANTILES})
    return stats.where(F.col("n") >= least)


def boxplot(rows: DataFrame, code: str, columns: list[str]) -> DataFrame:
    """Quartiles, extremes, and the whisker ends at 1.5 interquartile ranges, cut to the data."""
    # The 0 and 1 quantiles are the extremes.
    stats = exact_quantiles(unpivoted(rows, [code], columns), [code, "variable"], "value", {"low": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "high": 1.0})
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    return stats.withColumns({"whisker_low": F.greatest("low", F.col("q1") - reach), "whisker_high": F.least("high", F.col("q3") + reach)})


def percentile_position(rows: DataFrame, key: str, code: str, percentiles: DataFrame, columns: list[str]) -> DataFrame:
    """Each value of each point against the percentiles of its class; ``inside`` is the middle half.

    The position is linear between the percentiles that are known, 5 below and 95 above them. Percentiles that don't
    rise are set apart by a billionth, so that each value has one position.
    """
    v, knots = F.col("value"), [round(q * 100) for q in QUANTILES]
    met = unpivoted(rows, [key, code], columns).join(percentiles, [code, "variable"])
    met = met.withColumn(f"k{knots[0]}", F.col(f"p{knots[0]}"))
    for a, b in zip(knots, knots[1:]):
        met = met.withColumn(f"k{b}", F.when(F.col(f"p{b}") <= F.col(f"k{a}"), F.col(f"k{a}") + 1e-9).otherwise(F.col(f"p{b}")))
    position = F.when(v < F.col(f"k{knots[0]}"), F.lit(5.0))
    for a, b in zip(knots, knots[1:]):
        low, high = F.col(f"k{a}"), F.col(f"k{b}")
        position = position.when(v <= high, a + (b - a) * (v - low) / (high - low))
    return met.select(key, code, "variable", "value", position.otherwise(F.lit(95.0)).alias("position"), v.between(F.col("p25"), F.col("p75")).alias("inside"))


def histogram(rows: DataFrame, value: str, width: float) -> DataFrame:
    """Count in each bin of a probability; 1 belongs to the last bin."""
    last = round(1 / width) - 1
    return rows.where(F.col(value).isNotNull()).groupBy(F.least(F.floor(F.round(F.col(value) / width, 9)), F.lit(last)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def nested_counts(rows: DataFrame, levels: list[str]) -> DataFrame:
    """Counts of each level within the levels above, with subtotals (null below a subtotal)."""
    return rows.rollup(*levels).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("depth"))


def contingency(rows: DataFrame, row: str, column: str, values: list) -> DataFrame:
    return rows.groupBy(row).pivot(column, values).agg(F.count(F.lit(1))).na.fill(0)


def yearly_span(rows: DataFrame, keys: list[str], year: str, columns: list[str]) -> DataFrame:
    """``keys, variable, mean, low, high, years``: over the yearly means of each variable their mean, least and largest."""
    yearly = unpivoted(rows, [*keys, year], columns).groupBy(*keys, year, "variable").agg(F.avg("value").alias("y"))
    return yearly.groupBy(*keys, "variable").agg(F.avg("y").alias("mean"), F.min("y").alias("low"), F.max("y").alias("high"), F.count(F.lit(1)).alias("years"))


def class_scatter(rows: DataFrame, key: str, code: str, x: str, y: str, names: dict) -> DataFrame:
    """``key, class, x, y`` of the rows that have both values, by the name of their class; rows of other classes are ``other``."""
    name = F.lit(None).cast("string")
    for k, v in names.items():
        name = F.when(F.col(code) == k, F.lit(v)).otherwise(name)
    return rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(key, F.coalesce(name, F.lit("other")).alias("class"), F.col(x).alias("x"), F.col(y).alias("y"))


def zone_counts(rows: DataFrame, zone: str, code: str) -> DataFrame:
    """``code, n, zones``: rows of each class, and how many zones they come from."""
    return rows.groupBy(code).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(zone).alias("zones"))
