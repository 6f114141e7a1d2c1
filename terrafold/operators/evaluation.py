"""Metrics, thresholds and rank statistics on stored probabilities (truth 0/1, score)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrafold.sources.tables import saved


def _score_counts(rows: DataFrame, truth: str, score: str) -> DataFrame:
    return rows.where(F.col(score).isNotNull() & F.col(truth).isNotNull()).groupBy(F.col(score).alias("s")).agg(
        F.count_if(F.col(truth) == 1).alias("pos"), F.count_if(F.col(truth) == 0).alias("neg"))


def _before(counts: DataFrame) -> DataFrame:
    """Each distinct score with the positives and negatives of smaller scores.

    Scores are dealt to ranges, as many as a shuffle has partitions; each range is summed for
    itself and continues from the ranges before, so no task sorts all.
    """
    cut = saved(counts.repartitionByRange("s").withColumn("range", F.spark_partition_id()), "score-ranges")
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    sums = cut.groupBy("range").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    sums = sums.select("range", F.coalesce(F.sum("p").over(earlier), F.lit(0)).alias("p0"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"))
    inside = Window.partitionBy("range").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    return cut.join(F.broadcast(sums), "range").select(  # sums has one row a range
        "s", "pos", "neg", (F.col("p0") + F.coalesce(F.sum("pos").over(inside), F.lit(0))).alias("pos_before"), (F.col("n0") + F.coalesce(F.sum("neg").over(inside), F.lit(0))).alias("neg_before"))


def auc(rows: DataFrame, truth: str, score: str) -> DataFrame:
    """Area under the ROC curve: the share of positive-negative pairs in the right order, ties half."""
    counts = _before(_score_counts(rows, truth, score))
    good = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0))
    return counts.agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), good.alias("good")).select(
        "n_pos", "n_neg", F.try_divide(F.col("good"), (F.col("n_pos") * F.col("n_neg")).cast("double")).alias("auc"))


def youden(rows: DataFrame, truth: str, score: str) -> DataFrame:
    """The score, as a threshold from above, with the largest sensitivity + specificity - 1; the highest of equals."""
    counts = _before(_score_counts(rows, truth, score))
    total = counts.agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    j = (F.col("all_pos") - F.col("pos_before")) / F.col("all_pos") - (F.col("all_neg") - F.col("neg_before")) / F.col("all_neg")
    each = counts.crossJoin(F.broadcast(total)).select("s", F.round(j, 9).alias("j"))  # total is one row
    return each.orderBy(F.desc("j"), F.desc("s")).limit(1).select(F.col("s").alias("threshold"), "j")


def threshold_sweep(rows: DataFrame, truth: str, score: str, first: int = 25, last: int = 975, step: int = 25) -> DataFrame:
    """Counts and rates at each threshold (in thousandths), from one pass over the rows."""
    at = list(range(first, last + 1, step))
    hit = lambda t: F.col(score) >= t / 1000
    sums = rows.agg(*[x for t in at for x in (
        F.count_if(hit(t) & (F.col(truth) == 1)).alias(f"tp{t}"), F.count_if(hit(t) & (F.col(truth) == 0)).alias(f"fp{t}"),
        F.count_if(~hit(t) & (F.col(truth) == 1)).alias(f"fn{t}"), F.count_if(~hit(t) & (F.col(truth) == 0)).alias(f"tn{t}"))])
    each = sums.select(F.inline(F.array(*[F.struct((F.lit(t) / 1000).alias("threshold"), *[F.col(f"{c}{t}").alias(c) for c in ("tp", "fp", "fn", "tn")]) for t in at])))
    rate = lambda a, b: F.try_divide(F.col(a).cast("double"), (F.col(a) + F.col(b)).cast("double"))
    each = each.withColumns({"sensitivity": rate("tp", "fn"), "specificity": rate("tn", "fp"), "precision": rate("tp", "fp")})
    f1 = F.try_divide(2.0 * F.col("tp"), (2 * F.col("tp") + F.col("fp") + F.col("fn")).cast("double"))
    return each.withColumns({"f1": f1, "tss": F.col("sensitivity") + F.col("specificity") - 1})


def best_threshold(sweep: DataFrame, criterion: str = "f1") -> DataFrame:
    """The middle of the longest run of thresholds that share the best value; of equal runs the one nearest to 0.5."""
    order = Window.orderBy("threshold")  # one row a threshold
    ranked = sweep.withColumn("i", F.row_number().over(order)).withColumn("best", F.max(F.round(criterion, 9)).over(Window.partitionBy()))
    top = ranked.where(F.round(criterion, 9) == F.col("best")).withColumn("island", F.col("i") - F.row_number().over(order))
    runs = top.groupBy("island").agg(F.count(F.lit(1)).alias("n"), F.avg("threshold").alias("threshold"), F.first("best").alias("best"))
    return runs.orderBy(F.desc("n"), F.abs(F.col("threshold") - 0.5), "threshold").limit(1).select("threshold", F.col("n").alias("run"), F.col("best").alias("value"))


def otsu(rows: DataFrame, score: str, bins: int = 256, low: float = 0.30, high: float = 0.80) -> DataFrame:
    """Threshold that parts the histogram best, kept within bounds; 0.5 for fewer than 8 values or hardly any range."""
    seen = rows.where(F.col(score).isNotNull())
    span = seen.agg(F.min(score).alias("lo"), F.max(score).alias("hi"), F.count(score).alias("total"))
    binned = seen.crossJoin(F.broadcast(span)).withColumn(  # span is one row
        "bin", F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col(score) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(F.lit(0)))
    hist = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.first("total").alias("total"))
    hist = hist.withColumn("centre", F.col("lo") + (F.col("bin") + 0.5) * (F.col("hi") - F.col("lo")) / bins)
    up = Window.orderBy("bin")  # at most one row a bin
    hist = hist.withColumns({"w": F.sum("n").over(up), "m": F.sum(F.col("n") * F.col("centre")).over(up), "all_m": F.sum(F.col("n") * F.col("centre")).over(Window.partitionBy())})
    rest = F.col("total") - F.col("w")
    between = F.when((F.col("w") > 0) & (rest > 0), F.col("w") * rest * F.pow(F.col("m") / F.col("w") - F.try_divide(F.col("all_m") - F.col("m"), rest), F.lit(2)))
    best = hist.withColumn("between", F.round(between / F.pow(F.col("total"), F.lit(2)), 9)).orderBy(F.desc_nulls_last("between"), "bin").limit(1)
    poor = (F.col("total") < 8) | (F.col("hi") - F.col("lo") < 1e-3) | F.col("between").isNull()
    return best.select(F.when(poor, F.lit(0.5)).otherwise(F.least(F.greatest("centre", F.lit(low)), F.lit(high))).alias("threshold"))


def confusion(rows: DataFrame, real: str, predicted: str) -> DataFrame:
    return rows.groupBy(real, predicted).agg(F.count(F.lit(1)).alias("n"))


def class_metrics(matrix: DataFrame, real: str, predicted: str) -> DataFrame:
    """Precision, recall and F1 of each class of a confusion matrix."""
    by_real = matrix.groupBy(F.col(real).alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col(real) == F.col(predicted), F.col("n")).otherwise(F.lit(0))).alias("tp"))
    by_predicted = matrix.groupBy(F.col(predicted).alias("class")).agg(F.sum("n").alias("predicted"))
    both = by_real.join(by_predicted, "class", "full").na.fill(0, ["support", "tp", "predicted"])
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    return both.select("class", "support", "predicted", "tp", ratio(F.col("tp"), F.col("predicted")).alias("precision"), ratio(F.col("tp"), F.col("support")).alias("recall"),
                       ratio(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"))


def summary_metrics(metrics: DataFrame) -> DataFrame:
    """Accuracy, balanced accuracy and macro F1 from the metrics of classes."""
    return metrics.agg((F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
                       F.avg("f1").alias("macro_f1"), F.sum("support").cast("long").alias("n"))


def importance_ranks(rows: DataFrame, drop: str, impurity: str, place: str) -> DataFrame:
    """Variables ranked by what their permutation costs, then by impurity, then by their place in the catalogue."""
    order = Window.orderBy(F.desc(F.round(drop, 9)), F.desc(F.round(impurity, 9)), place)  # one row a variable
    return rows.withColumn("rank", F.row_number().over(order))


def fold_metrics(rows: DataFrame, fold: str, real: str, predicted: str) -> DataFrame:
    """``fold, n, accuracy, macro_f1`` of the rows of each fold; classes that a fold neither has nor predicts don't count in it."""
    counts = rows.groupBy(fold, real, predicted).agg(F.count(F.lit(1)).alias("n"))
    hit = F.col(real) == F.col(predicted)
    sides = F.array(F.struct(F.col(real).alias("class"), F.lit(1).alias("is_real")), F.struct(F.col(predicted).alias("class"), F.lit(0).alias("is_real")))
    each = counts.select(fold, "n", hit.alias("hit"), F.inline(sides)).groupBy(fold, "class").agg(F.sum("n").alias("both"), F.sum(F.when(F.col("hit") & (F.col("is_real") == 1), F.col("n")).otherwise(F.lit(0))).alias("tp"), F.sum(F.when(F.col("is_real") == 1, F.col("n")).otherwise(F.lit(0))).alias("support"))
    return each.groupBy(fold).agg(F.sum("support").alias("n"), (F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg(2 * F.col("tp") / F.col("both")).alias("macro_f1"))


CRITERIA = ("f1", "tss", "manual")


def chosen_threshold(sweep: DataFrame, criterion: str = "f1", manual: float | None = None, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """One row ``threshold, run, value``: the best by F1 or by TSS, or a manual cut with the figures of its nearest threshold; ValueError where it is out of range."""
    if criterion not in CRITERIA:
        raise ValueError(f"criterion: one of {', '.join(CRITERIA)}")
    if criterion != "manual":
        return best_threshold(sweep, criterion)
    if manual is None or not low <= manual <= high:
        raise ValueError(f"a manual threshold lies between {low:g} and {high:g}")
    near = sweep.orderBy(F.round(F.abs(F.col("threshold") - manual), 9), "threshold").limit(1)
    return near.select(F.lit(manual).alias("threshold"), F.lit(1).cast("long").alias("run"), F.col("f1").alias("value"))


def macro_f1_of_batches(rows: DataFrame, batch: list[str], real: str, predicted: str, classes: list) -> DataFrame:
    """``batch, macro_f1`` of many sets of predictions at once, over the given classes: 0 for one that is neither there nor predicted."""
    counts = rows.groupBy(*batch, real, predicted).agg(F.count(F.lit(1)).alias("n"))
    of = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    each = [2 * of((F.col(real) == c) & (F.col(predicted) == c)) / F.greatest(of(F.col(real) == c) + of(F.col(predicted) == c), F.lit(1)) for c in classes]
    return counts.groupBy(*batch).agg((sum(each[1:], each[0]) / len(classes)).alias("macro_f1"))
