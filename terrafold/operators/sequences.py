"""Runs, histories and order statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrafold.operators.quantiles import at_ranks


def year_ranges(rows: DataFrame, key: str, year: str) -> DataFrame:
    """The years of each key as text: single years and ranges of consecutive ones."""
    years = rows.select(key, year).distinct()
    island = F.col(year) - F.row_number().over(Window.partitionBy(key).orderBy(year))
    runs = years.withColumn("island", island).groupBy(key, "island").agg(F.min(year).alias("a"), F.max(year).alias("b"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", "a", "b"))
    return runs.withColumn("t", F.struct("a", text.alias("text"))).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["text"]), ", ").alias("years"))


def upper_median(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """The element at place n div 2 (from 0) of the sorted values; it is not interpolated. Values are numbers; groups may be of any size."""
    found = at_ranks(rows, by, value, {"upper": F.floor(F.col("n") / 2)})
    return found.select(*by, F.col("low_").cast(rows.schema[value].dataType).alias(value))


def deltas(history: DataFrame, order: str, size: str) -> DataFrame:
    """What each iteration added, and whether it had converged."""
    w = Window.orderBy(order)  # one row an iteration
    new = F.col(size) - F.coalesce(F.lag(size).over(w), F.lit(0))
    return history.withColumn("n_new", new).withColumn("converged", new == 0)


def legend(codes: DataFrame, order: str, branch: str) -> DataFrame:
    """Rows of a legend: a title wherever the branch changes, then the entries."""
    starts = F.coalesce(F.lag(branch).over(Window.orderBy(order)) != F.col(branch), F.lit(True))  # one row a class
    marked = codes.withColumn("starts", starts)
    kinds = F.when(F.col("starts"), F.array(F.lit("title"), F.lit("entry"))).otherwise(F.array(F.lit("entry")))
    return marked.select("*", F.explode(kinds).alias("kind")).drop("starts")


def shortened(rows: DataFrame, value: str, longest: int = 12) -> DataFrame:
    """Values without the beginning that all share, where they are long."""
    ends = rows.agg(F.min(value).alias("lo_"), F.max(value).alias("hi_"))
    same = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length("lo_"), F.lit(1))), F.lit(0), lambda n, i: F.when((n == i - 1) & (F.substring(F.col("lo_"), i, F.lit(1)) == F.substring(F.col("hi_"), i, F.lit(1))), i).otherwise(n))
    both = rows.crossJoin(F.broadcast(ends.withColumn("n_", same)))  # one row
    return both.withColumn("short", F.when(F.length(value) > longest, F.expr(f"substring({value}, n_ + 1)")).otherwise(F.col(value))).drop("lo_", "hi_", "n_")


def top_by(rows: DataFrame, by: list[str], pick: str, score: list) -> DataFrame:
    """The candidate with the best score of each group; the smallest of equals."""
    best = Window.partitionBy(*by).orderBy(*[s.desc() for s in score], pick)
    return rows.withColumn("r_", F.row_number().over(best)).where("r_ = 1").drop("r_")
