"""Discovery of label columns, and truth points merged into candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrafold.functions.labels import yes_no
from terrafold.operators.spatial import nearest_within


def column_quality(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``name, priority, filled, understood`` of each candidate column, in one pass over the rows."""
    counts = rows.agg(*[x for i, c in enumerate(columns) for x in (
        F.count_if(yes_no(F.col(c)) != "").alias(f"f{i}"), F.count_if(yes_no(F.col(c)).isin("yes", "no")).alias(f"u{i}"))])
    each = F.array(*[F.struct(F.lit(c).alias("name"), F.lit(i).alias("priority"), F.col(f"f{i}").alias("filled"), F.col(f"u{i}").alias("understood")) for i, c in enumerate(columns)])
    return counts.select(F.inline(each))


def discover(rows: DataFrame, columns: list[str], share: float = 0.9) -> DataFrame:
    """The first column, in order of priority, of which at least a share of the values is understood."""
    fine = column_quality(rows, columns).where((F.col("filled") > 0) & (F.col("understood") >= share * F.col("filled")))
    return fine.orderBy("priority").limit(1)


def unknown_values(rows: DataFrame, column: str, most: int = 8) -> DataFrame:
    """The most frequent values that are not understood."""
    return rows.where(yes_no(F.col(column)) == "?").groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(most)


def merge_truth(points: DataFrame, truth: DataFrame, tolerance: float = 20.0) -> DataFrame:
    """Upsert of truth points: the nearest candidate within the tolerance gets the label, a truth without one is appended.

    Points have id, x, y and label; truth has ord, x, y and label. Of several truths on a candidate the last wins.
    """
    hit = nearest_within(truth.withColumnRenamed("ord", "from_id"), points.select(F.col("id").alias("to_id"), "x", "y"), tolerance)
    last = Window.partitionBy("to_id").orderBy(F.desc("from_id"))
    chosen = hit.join(truth.select(F.col("ord").alias("from_id"), F.col("label").alias("truth_label")), "from_id")
    chosen = chosen.withColumn("r", F.row_number().over(last)).where("r = 1").select(F.col("to_id").alias("id"), "truth_label")
    merged = points.join(chosen, "id", "left").select("id", "x", "y", F.coalesce("truth_label", "label").alias("label"), F.when(F.col("truth_label").isNotNull(), F.lit("matched")).otherwise(F.lit("candidate")).alias("origin"))
    rest = truth.join(hit.select(F.col("from_id").alias("ord")), "ord", "left_anti")
    return merged.unionByName(rest.select(F.concat(F.lit("t"), F.col("ord").cast("string")).alias("id"), "x", "y", "label", F.lit("truth").alias("origin")))
