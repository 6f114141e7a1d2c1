"""From reviewed points to a training table: eligibility, duplicates, completeness, balance and folds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrafold.operators.quantiles import column_quantiles


def eligibility(label: Column, doubtful: Column, category: Column, invalid: Column) -> Column:
    """Struct of category (0 absence, null unused), origin and reason."""
    struct = lambda cat, origin, why: F.struct(cat.alias("category"), F.lit(origin).alias("origin"), F.lit(why).alias("reason"))
    none = F.lit(None).cast("int")
    return (
        F.when(F.coalesce(doubtful, F.lit(False)), struct(none, None, "doubtful")).when(label == "no", struct(F.lit(0), "label", None))
        .when(F.coalesce(invalid, F.lit(False)), struct(none, None, "invalid category")).when(label == "?", struct(none, None, "label not understood"))
        .when((label == "yes") & category.isNull(), struct(none, None, "no category")).when(label == "yes", struct(category.cast("int"), "review", None))
        .otherwise(struct(none, None, "no label")))


def same_pixel(rows: DataFrame, pixel: list[str], category: str, order: str) -> DataFrame:
    """Several samples on a pixel: of one class the first stays, of different classes none."""
    w = Window.partitionBy(*pixel)
    rank = F.row_number().over(w.orderBy(order))
    conflict = F.min(category).over(w) != F.max(category).over(w)
    return rows.withColumn("pixel_reason", F.when(conflict, F.lit("conflict")).when(rank > 1, F.lit("duplicate")))


def class_counts(rows: DataFrame, classes: DataFrame, code: str) -> DataFrame:
    """Count of every class of the catalogue, 0 included."""
    seen = rows.groupBy(code).agg(F.count(F.lit(1)).alias("n"))
    return classes.join(seen, code, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def sufficiency(n: Column, least: int = 5, few: int = 30) -> Column:
    return F.when(n < least, F.lit("error")).when(n < few, F.lit("warning")).otherwise(F.lit("ok"))


def completeness(rows: DataFrame, predictors: list[str], read: Column) -> DataFrame:
    """``missing`` lists absent predictors; ``reason`` is null where a row can be used."""
    missing = F.array_compact(F.array(*[F.when(F.col(p).isNull(), F.lit(p)) for p in predictors]))
    reason = F.when(~read, F.lit("not read")).when(F.size("missing") == len(predictors), F.lit("no coverage")).when(F.size("missing") > 0, F.lit("no value"))
    return rows.withColumn("missing", missing).withColumn("reason", reason)


def undersample(rows: DataFrame, code: str, ratio: float, order: list[Column | str]) -> DataFrame:
    """At most ``max(smallest, floor(smallest * ratio))`` rows a class, in the given order."""
    smallest = rows.groupBy(code).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n")).first()[0] or 0
    ranked = rows.withColumn("rank_", F.row_number().over(Window.partitionBy(code).orderBy(*order)))
    # A number that the plan knows lets each task keep only so many rows of a class before they travel.
    return ranked.where(F.col("rank_") <= max(smallest, int(smallest * ratio))).drop("rank_")


def group_folds(rows: DataFrame, group: str, k: int) -> DataFrame:
    """``group, n, fold``: groups by falling size go to folds in turn, back and forth, so that sizes even out."""
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.orderBy(F.desc("n"), group)) - 1  # one row a group
    lap, at = F.floor(place / k), place % k
    return sizes.withColumn("fold", F.when(lap % 2 == 0, at).otherwise(k - 1 - at).cast("int"))


def _fold_chooser(k: int, n_classes: int):
    """A function that deals groups (in the order they come) to the fold that evens the classes most."""
    def deal(batches):
        totals = None
        for rows in batches:
            counts = np.array(rows["counts"].tolist(), np.float64).reshape(len(rows), n_classes)
            if totals is None:
                totals = np.array(rows["totals"].iloc[0], np.float64)
                held, sizes = np.zeros((k, n_classes)), np.zeros(k)
            folds = []
            for own in counts:
                spread = []
                for f in range(k):
                    held[f] += own
                    spread.append((round(float((held / totals).std(axis=0).mean()), 9), sizes[f], f))
                    held[f] -= own
                f = min(spread)[2]
                held[f] += own
                sizes[f] += own.sum()
                folds.append(f)
            yield rows[["group"]].assign(n=counts.sum(axis=1).astype("int64"), fold=np.array(folds, "int32"))

    return deal


def stratified_group_folds(rows: DataFrame, group: str, code: str, k: int = 5) -> DataFrame:
    """``group, n, fold``: whole groups in k folds whose classes are alike.

    Groups by falling spread of their class counts (then by name) go each to the fold with which the deviation of the classes' shares
    over the folds is least; of equals to the smaller, then to the first fold. One row a group is dealt in one task: groups are zones, whose
    number follows the area and not the samples.
    """
    classes = [r[0] for r in rows.select(code).distinct().orderBy(code).collect()]  # one row a class
    each = [F.count_if(F.col(code) == c).cast("double") for c in classes]
    counts = rows.groupBy(F.col(group).cast("string").alias("group")).agg(F.array(*each).alias("counts"))
    totals = rows.agg(F.array(*each).alias("totals"))
    mean = F.aggregate("counts", F.lit(0.0), lambda a, x: a + x) / len(classes)
    spread = F.round(F.sqrt(F.aggregate("counts", F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / len(classes)), 9)
    ordered = counts.crossJoin(F.broadcast(totals)).withColumn("spread", spread).repartition(1).sortWithinPartitions(F.desc("spread"), "group")
    return ordered.select("group", "counts", "totals").mapInPandas(_fold_chooser(k, len(classes)), "group string, n long, fold int").withColumnRenamed("group", group)


def stratified_folds(rows: DataFrame, key: str, code: str, k: int, seed: int = 42) -> DataFrame:
    """``rows`` with ``fold``: the rows of each class, in the order of a hash, go to the folds in turn.

    Rows are numbered within ranges of the hash, and a range begins where the ones before end, so no class is in one task.
    """
    place = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 31))
    ranged = rows.withColumns({"place_": place, "range_": F.floor(place / (1 << 21)).cast("int")})
    sums = ranged.groupBy(code, "range_").agg(F.count(F.lit(1)).alias("n_"))
    before = Window.partitionBy(code).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)  # at most 1024 ranges a class
    sums = sums.withColumn("before_", F.coalesce(F.sum("n_").over(before), F.lit(0))).drop("n_")
    at = F.row_number().over(Window.partitionBy(code, "range_").orderBy("place_", key)) - 1
    return ranged.withColumn("at_", at).join(sums, [code, "range_"]).withColumn("fold", ((F.col("at_") + F.col("before_")) % k).cast("int")).select(*rows.columns, "fold")


def spatial_folds(rows: DataFrame, key: str, group: str, code: str, k: int = 5, least_groups: int = 3, seed: int = 42) -> tuple[DataFrame, str, list[tuple[str, object]]]:
    """``rows`` with ``fold``, the kind of folds, and warnings: by groups where there are ``least_groups`` of them, else by class
    alone (``no groups``, with their number); ``class in one group`` names classes that some fold cannot have learned."""
    n_groups = rows.select(group).distinct().count()
    sizes = rows.groupBy(code).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(group).alias("g")).orderBy(code).collect()  # one row a class
    if n_groups >= least_groups:
        k = min(k, n_groups)
        folds = stratified_group_folds(rows, group, code, k).select(F.col(group).alias("group_"), "fold")
        out = rows.join(folds, rows[group].cast("string").eqNullSafe(F.col("group_"))).drop("group_")
        return out, "groups", [("class in one group", r[0]) for r in sizes if r.g == 1]
    k = max(2, min(k, min((r.n for r in sizes), default=2)))
    return stratified_folds(rows, key, code, k, seed), "classes", [("no groups", n_groups)]


def medians_of(rows: DataFrame, columns: list[str]) -> dict[str, float]:
    """The exact median of each column, 0 where it is empty."""
    found = column_quantiles(rows, {c: (c, 0.5) for c in columns}).first()
    return {c: 0.0 if found[c] is None else float(found[c]) for c in columns}


def median_imputed(rows: DataFrame, columns: list[str], medians: dict[str, float] | None = None) -> DataFrame:
    """Nulls become the column's median: the given one, or that of these rows."""
    medians = medians_of(rows, columns) if medians is None else medians
    return rows.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(float(medians[c]))) for c in columns})


def within_range(rows: DataFrame, value: str, low: float | None, high: float | None) -> DataFrame:
    """Rows whose value lies within the limits; without a value they go, and a limit of 0 or none is no limit."""
    if not (low or high):
        return rows
    keep = F.col(value).isNotNull()
    for limit, inside in ((low, F.col(value) >= (low or 0)), (high, F.col(value) <= (high or 0))):
        keep = keep & inside if limit else keep
    return rows.where(keep)


def without_truth(rows: DataFrame) -> DataFrame:
    """Rows that did not come from the layer of truth."""
    return rows.where(~F.coalesce(F.col("source") == "truth", F.lit(False)))


def without(rows: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among the chosen ones."""
    return rows.join(chosen.select(key).distinct(), key, "left_anti")


def catalogue_union(catalogue: list[str], *sets: list[str]) -> list[str]:
    """The predictors of any of the sets, in the catalogue's order and once each."""
    known = {p for one in sets for p in one}
    if lost := known - set(catalogue):
        raise ValueError(f"not in the catalogue: {', '.join(sorted(lost))}")
    return [p for p in catalogue if p in known]
