"""Random forests on feature columns: weights, grouped folds, importances, and self-training sets."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrafold.operators.samples import group_folds, medians_of, undersample
from terrafold.operators.spatial import far_from

#: What the description of a saved model has at least.
REQUIRED = ("predictors", "classes", "n_rows", "medians")
#: How classes of different size are evened out.
STRATEGIES = ("weights", "undersample", "both", "none")


@dataclass(frozen=True)
class Bundle:
    """A forest with what it takes to apply it: the predictors in order, and their medians in the rows it was trained on."""

    forest: RandomForestClassificationModel
    predictors: tuple[str, ...]
    medians: dict[str, float]


def with_features(rows: DataFrame, predictors: list[str] | tuple[str, ...], medians: dict[str, float]) -> DataFrame:
    """``rows`` with ``features``: missing predictors (null or NaN) as the given medians. The predictors stay as they are."""
    values = [F.coalesce(F.when(~F.isnan(F.col(p).cast("double")), F.col(p).cast("double")), F.lit(float(medians[p]))) for p in predictors]
    return rows.withColumn("features", array_to_vector(F.array(*values)))


def weighted(rows: DataFrame, code: str) -> DataFrame:
    """Weight n / (classes * n of the class), so that classes count alike."""
    sizes = rows.groupBy(code).agg(F.count(F.lit(1)).alias("n_class"))
    total = sizes.agg(F.sum("n_class").alias("n_all"), F.count(F.lit(1)).alias("k"))
    return rows.join(sizes.crossJoin(F.broadcast(total)), code).withColumn("weight", F.col("n_all") / (F.col("k") * F.col("n_class"))).drop("n_class", "n_all", "k")


def valid_parameters(trees: int, depth: int | None, least: int, subset: str) -> int:
    """The depth that a forest gets (none is the deepest one that MLlib grows); ValueError where a parameter is out of range."""
    if trees < 10:
        raise ValueError("trees: 10 or more")
    if depth is not None and depth < 1:
        raise ValueError("depth: none or 1 and more")
    if least < 1:
        raise ValueError("least: 1 or more")
    if subset not in ("sqrt", "log2", "all") and not (subset.isdigit() and int(subset) >= 1):
        raise ValueError("subset: sqrt, log2, all or a number")
    return 30 if depth is None else min(depth, 30)


def fit_forest(rows: DataFrame, code: str, predictors: list[str], trees: int = 100, depth: int | None = 12, least: int = 2, seed: int = 42, strategy: str = "weights",
               ratio: float = 3.0, key: str | None = None, subset: str = "sqrt") -> Bundle:
    """A forest of the rows. ``strategy``: weights by class, or abundant classes cut to ``ratio`` times the smallest (in the
    order of a hash of ``key``), or both, or none. Medians are of the rows it is trained on."""
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy: one of {', '.join(STRATEGIES)}")
    depth = valid_parameters(max(trees, 10), depth, least, subset)
    if strategy in ("undersample", "both"):
        if key is None:
            raise ValueError("undersampling needs the key of the rows")
        rows = undersample(rows, code, ratio, [F.xxhash64(F.lit(seed), F.col(key)), key])
    medians = medians_of(rows, predictors)
    table = with_features(rows, predictors, medians)
    balanced = strategy in ("weights", "both")
    forest = RandomForestClassifier(featuresCol="features", labelCol=code, numTrees=trees, maxDepth=depth, minInstancesPerNode=least, seed=seed, featureSubsetStrategy=subset)
    return Bundle((forest.setWeightCol("weight") if balanced else forest).fit(weighted(table, code) if balanced else table), tuple(predictors), medians)


def save_model(model: Bundle, path: str, about: dict) -> None:
    """The forest, and beside it what it was trained on (``REQUIRED`` keys and any others); the description comes last."""
    about = {**about, "predictors": list(model.predictors), "medians": model.medians}
    if lost := [k for k in REQUIRED if k not in about]:
        raise ValueError(f"the description lacks {', '.join(lost)}")
    spark = SparkSession.active()
    model.forest.write().overwrite().save(f"{path}/forest")
    spark.createDataFrame([(json.dumps(about, sort_keys=True),)], "about string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def load_model(spark: SparkSession, path: str) -> tuple[Bundle, dict]:
    """A saved forest with its medians, and its description; ValueError where the description lacks a key or does not fit the forest."""
    about = json.loads(spark.read.text(f"{path}/about").first()[0])
    if lost := [k for k in REQUIRED if k not in about]:
        raise ValueError(f"{path}: the description lacks {', '.join(lost)}")
    forest = RandomForestClassificationModel.load(f"{path}/forest")
    if forest.numFeatures != len(about["predictors"]) or set(about["medians"]) != set(about["predictors"]):
        raise ValueError(f"{path}: {forest.numFeatures} predictors in the forest, {len(about['predictors'])} in its description, {len(about['medians'])} medians")
    return Bundle(forest, tuple(about["predictors"]), about["medians"]), about


def importance_table(spark: SparkSession, model: Bundle) -> DataFrame:
    """``rank, variable, importance`` with six decimals as text, for a file."""
    rows = [(k + 1, name, f"{value:.6f}") for k, (name, value) in enumerate(importances(model))]  # one row a predictor
    return spark.createDataFrame(rows, "rank int, variable string, importance string")


def presence_labels(rows: DataFrame, least: float = 250.0) -> DataFrame:
    """``rows`` (id, x, y, label, doubtful) with ``code``: 1 for a known yes, 0 for a known no and for unlabelled rows
    farther than ``least`` from every yes, doubtful ones included; null for the doubtful and all others, which train nothing."""
    sure = ~F.coalesce(F.col("doubtful"), F.lit(False))
    positives = rows.where(F.col("label") == "yes").select(F.col("id").alias("to_id"), "x", "y")
    free = rows.where((F.coalesce("label", F.lit("")) == "") & sure).select(F.col("id").alias("from_id"), "x", "y")
    absent = far_from(free, positives, least, strictly=True).select(F.col("from_id").alias("id"), F.lit(True).alias("far_"))
    code = F.when(~sure, F.lit(None).cast("double")).when(F.col("label") == "yes", F.lit(1.0)).when(F.col("label") == "no", F.lit(0.0)).when(F.col("far_"), F.lit(0.0))
    return rows.join(absent, "id", "left").withColumn("code", code).drop("far_")


def detector(rows: DataFrame, predictors: list[str], fallback: str | None = None, least: int = 15, **options) -> tuple[Bundle | None, str]:
    """A forest of the rows' own labels; with fewer than ``least`` of either class the saved one, if there is any. Says which.

    The saved one comes with its own medians, so a row's probability does not depend on the rows it is asked with.
    """
    table = presence_labels(rows)
    sizes = {r.code: r.n for r in table.where("code is not null").groupBy("code").agg(F.count(F.lit(1)).alias("n")).collect()}
    if min(sizes.get(0.0, 0), sizes.get(1.0, 0)) >= least:
        return fit_forest(table.where("code is not null"), "code", predictors, **options), "own"
    if fallback is None:
        return None, "none"
    model, about = load_model(rows.sparkSession, fallback)
    if about["predictors"] != list(predictors):
        raise ValueError(f"{fallback}: trained on other predictors")
    return model, "saved"


def predict(model: Bundle, rows: DataFrame) -> DataFrame:
    """``rows`` with the probabilities of all classes and the predicted class. Missing predictors are the model's own medians,
    so each row is predicted alike alone, in a block and in the whole. Nothing is shuffled."""
    done = model.forest.transform(with_features(rows, model.predictors, model.medians))
    done = done.withColumn("probabilities", vector_to_array("probability")).withColumn("predicted", F.col("prediction").cast("int"))
    return done.drop("features", "rawPrediction", "probability", "prediction")


def cross_validated(rows: DataFrame, code: str, predictors: list[str], group: str, k: int = 5, **options) -> DataFrame:
    """Predictions for every row by a forest that has not seen its group."""
    folds = rows.join(group_folds(rows, group, k).select(group, "fold"), group)
    parts = []
    for i in range(k):
        inside, outside = folds.where(F.col("fold") != i), folds.where(F.col("fold") == i)
        parts.append(predict(fit_forest(inside, code, predictors, **options), outside))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def importances(model: Bundle) -> list[tuple[str, float]]:
    return sorted(zip(model.predictors, map(float, model.forest.featureImportances.toArray())), key=lambda x: -x[1])


def macro_f1(predictions: DataFrame, code: str) -> float:
    from terrafold.operators.evaluation import class_metrics, confusion

    return class_metrics(confusion(predictions, code, "predicted"), code, "predicted").agg(F.avg("f1")).first()[0]


def permuted(rows: DataFrame, columns: list[str], key: str, seed: int) -> DataFrame:
    """The columns of a set move together to other rows, by one permutation that the seed gives.

    Rows are ranked within ranges of two hashes and joined on range and rank, so no task orders all rows.
    """
    n = 64
    place = lambda k: F.pmod(F.xxhash64(F.lit(k), F.lit(seed), F.col(key)), F.lit(1 << 31))
    ranged = rows.withColumn("part_", F.pmod(F.xxhash64(F.lit(0), F.lit(seed), F.col(key)), F.lit(n)))
    left = ranged.withColumn("rank_", F.row_number().over(Window.partitionBy("part_").orderBy(place(1), key))).drop(*columns)
    right = ranged.select("part_", F.row_number().over(Window.partitionBy("part_").orderBy(place(2), key)).alias("rank_"), *columns)
    return left.join(right, ["part_", "rank_"]).drop("part_", "rank_").select(*rows.columns)


def permutation_importance(model: Bundle, rows: DataFrame, code: str, key: str, sets: dict[str, list[str]], repeats: int = 5) -> list[tuple[str, float, float]]:
    """For each set of columns the mean and sample deviation of the loss in macro F1 when it is permuted."""
    import statistics

    whole, out = macro_f1(predict(model, rows), code), []
    for name, columns in sets.items():
        losses = [whole - macro_f1(predict(model, permuted(rows, columns, key, seed)), code) for seed in range(repeats)]
        out.append((name, statistics.fmean(losses), statistics.stdev(losses) if repeats > 1 else 0.0))
    return sorted(out, key=lambda x: -x[1])


def promotable(rows: DataFrame, cutoff: float = 0.70) -> DataFrame:
    """Ids whose probability is high and whose label is neither no nor doubtful."""
    return rows.where((F.col("proba") >= cutoff) & (F.col("label") != "no") & ~F.coalesce(F.col("doubtful"), F.lit(False))).select("id")


def next_positives(base: DataFrame, previous: DataFrame, promoted: DataFrame, negatives: DataFrame, keep_previous: bool = True) -> DataFrame:
    """(previous or base, with the promoted) without the negatives; a set."""
    start = base.union(previous) if keep_previous else base
    return start.union(promoted).distinct().join(negatives, "id", "left_anti")


def self_training(rows: DataFrame, predictors: list[str], rounds: int = 5, cutoff: float = 0.70, **options) -> tuple[DataFrame, list[int]]:
    """Repeat: train on the positives, promote, until no new one comes. Returns the last positives and the news of each round."""
    from terrafold.sources.tables import saved

    base = rows.where("label = 'yes'").select("id")
    negatives = rows.where("label = 'no'").select("id")
    positives, news = saved(base.distinct(), "positives"), []
    for _ in range(rounds):
        table = rows.join(positives.withColumn("code", F.lit(1.0)), "id", "left").withColumn("code", F.coalesce("code", F.when(F.col("label") == "no", F.lit(0.0)))).where("code is not null")
        scored = predict(fit_forest(table, "code", predictors, **options), rows).withColumn("proba", F.element_at("probabilities", 2))
        after = saved(next_positives(base, positives, promotable(scored, cutoff), negatives), "positives")
        news.append(after.join(positives, "id", "left_anti").count())
        positives = after
        if not news[-1]:
            break
    return positives, news
