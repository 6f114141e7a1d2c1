"""Rounds of learning with a stored state: label, train, predict, decide and type; and a registry of runs that may be compared.

Each round is a folder ``round=k`` with the points and, written last, its statistics: a round without statistics does not count, so a loop that
was stopped goes on from the last whole round. Points have id, x, y, label, doubtful, the predictors, ``<level>_proposed`` types and, once
reviewed, reviewed and the levels themselves.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.operators import decisions, review, training
from terrafold.operators.mapping import _path, signature
from terrafold.sources.tables import saved

ADD, REPLACE = "add", "replace"


def _whole_rounds(spark: SparkSession, path: str) -> list[int]:
    at, files = _path(spark, path)
    if not files.exists(at):
        return []
    found = [x.getPath().getName() for x in files.listStatus(at)]
    return sorted(int(n[6:]) for n in found if n.startswith("round=") and files.exists(_path(spark, f"{path}/{n}/stats/_SUCCESS")[0]))


def state(spark: SparkSession, path: str) -> tuple[DataFrame, int] | None:
    """The points after the last whole round, and its number; none where there is none."""
    rounds = _whole_rounds(spark, path)
    return (spark.read.parquet(f"{path}/round={rounds[-1]}/points"), rounds[-1]) if rounds else None


def history(spark: SparkSession, path: str) -> DataFrame:
    """``round, model, n_base, n_prev_pos, n_promoted, n_new, n_train_pos, converged`` of the whole rounds."""
    rows = [json.loads(spark.read.text(f"{path}/round={k}/stats").first()[0]) for k in _whole_rounds(spark, path)]  # one row a round
    schema = "round int, model string, n_base long, n_prev_pos long, n_promoted long, n_new long, n_train_pos long, converged boolean"
    return spark.createDataFrame([tuple(r[f.split()[0]] for f in schema.split(", ")) for r in rows], schema)


def _keep(points: DataFrame, path: str, number: int, stats: dict) -> None:
    spark, place = points.sparkSession, f"{path}/round={number}"
    points.write.mode("overwrite").parquet(f"{place}/points")
    spark.createDataFrame([(json.dumps({"round": number, **stats}),)], "s string").coalesce(1).write.mode("overwrite").text(f"{place}/stats")


def _predicted(points: DataFrame, predictors: list[str], threshold: float, fallback: str | None, **options) -> tuple[DataFrame, str]:
    model, how = training.detector(points, predictors, fallback, **options)
    if model is None:
        scored = points if "proba" in points.columns else points.withColumn("proba", F.lit(None).cast("double"))
    else:
        scored = training.predict(model, points.drop("proba")).withColumn("proba", F.element_at("probabilities", 2)).drop("probabilities", "predicted")
    return scored.withColumn("decision", decisions.decide(F.col("proba"), F.col("label"), F.col("doubtful"), threshold)), how


def _typed(points: DataFrame) -> DataFrame:
    """Types of all points by the present decisions; what a person reviewed stays."""
    levels = {k: v for k, v in review.LEVELS.items() if f"{k}_proposed" in points.columns}
    for c in levels:
        points = points if c in points.columns else points.withColumn(c, F.lit(None).cast("string"))
    points = points if "reviewed" in points.columns else points.withColumn("reviewed", F.lit(False))
    return review.apply_types(points, levels) if levels else points


def begin(points: DataFrame, path: str, predictors: list[str], threshold: float = 0.5, fallback: str | None = None, **options) -> None:
    """Round 0: the verified yeses are the base; train, predict, decide and type. Nothing is done where a round exists."""
    if state(points.sparkSession, path):
        return
    rows = points.withColumn("base", F.coalesce((F.col("label") == "yes") & ~F.coalesce("doubtful", F.lit(False)), F.lit(False)))
    done, how = _predicted(rows, predictors, threshold, fallback, **options)
    n = rows.where("base").count()
    _keep(_typed(done).withColumn("origin", F.when(F.col("base"), F.lit("verified")).otherwise(F.lit("predicted"))), path, 0, {"model": how, "n_base": n, "n_prev_pos": n, "n_promoted": 0, "n_new": 0, "n_train_pos": n, "converged": False})


def verify(spark: SparkSession, path: str, verdicts: DataFrame) -> None:
    """What a person found: ``id, label`` (yes or no) becomes part of the base or an absence, in the state of the last round; its statistics stay."""
    points, number = state(spark, path)
    new = verdicts.select(F.col("id").alias("id_"), F.col("label").alias("label_")).dropDuplicates(["id_"])
    met = points.join(new, points["id"] == new["id_"], "left")
    seen = F.col("label_").isNotNull()
    out = met.withColumns({"label": F.coalesce("label_", "label"), "base": F.when(seen, F.col("label_") == "yes").otherwise(F.col("base")), "doubtful": F.when(seen, F.lit(False)).otherwise(F.col("doubtful"))}).select(*points.columns)
    out = saved(out, "verified")  # the folder that it is read from is written again
    stats = json.loads(spark.read.text(f"{path}/round={number}/stats").first()[0])
    _keep(out, path, number, {k: v for k, v in stats.items() if k != "round"})


def next_round(spark: SparkSession, path: str, predictors: list[str], cutoff: float = 0.70, mode: str = ADD, threshold: float = 0.5, fallback: str | None = None, **options) -> dict:
    """One round: promote what is likely and what no person denied or doubted, train on it, predict, decide and type again.

    ``add`` keeps earlier positives, ``replace`` starts from the base. Labels that a person gave are not touched. Returns the round's statistics.
    """
    if mode not in (ADD, REPLACE):
        raise ValueError("mode: add or replace")
    points, number = state(spark, path)
    ids = lambda cond: points.where(cond).select("id")
    previous, negatives, base = ids("label = 'yes'"), ids("label = 'no'"), ids("base")
    promoted = training.promotable(points.withColumn("label", F.coalesce("label", F.lit(""))), cutoff)
    positives = saved(training.next_positives(base, previous, promoted, negatives, mode == ADD), "positives")
    met = points.join(positives.withColumn("pos_", F.lit(True)), "id", "left")
    label = F.when(F.col("label") == "no", F.lit("no")).when(F.col("pos_"), F.lit("yes")).otherwise(F.lit(""))
    rows = saved(met.withColumn("label", label).drop("pos_").select(*points.columns), "relabelled")
    done, how = _predicted(rows, predictors, threshold, fallback, **options)
    done = _typed(review.origins(done.drop("origin"), base, positives))
    n_new = promoted.join(previous, "id", "left_anti").count()
    stats = {"model": how, "n_base": base.count(), "n_prev_pos": previous.count(), "n_promoted": promoted.count(), "n_new": n_new,
             "n_train_pos": rows.where("label = 'yes' and not coalesce(doubtful, false)").count(), "converged": n_new == 0}
    _keep(done.select(*dict.fromkeys([*points.columns, *done.columns])), path, number + 1, stats)
    return stats


def learn(spark: SparkSession, path: str, predictors: list[str], rounds: int = 5, **options) -> DataFrame:
    """Rounds until no point is new or so many are done, those before included. Returns the history."""
    while True:
        told = history(spark, path).orderBy(F.desc("round")).first()
        if told["round"] >= rounds or told.converged:
            return history(spark, path)
        next_round(spark, path, predictors, **options)


# Registry of runs

RUNS = "run string, level string, samples string, reading string, predictors array<string>, n_samples long, vif double, f1 double"


def sample_signature(rows: DataFrame, key: str, code: str) -> str:
    """Which samples with which class, whatever their predictors: runs of one signature may be compared."""
    return signature(rows.select(F.col(key).alias("id"), F.col(code).alias("code")), ["id", "code"]).first()[0]


def record_run(spark: SparkSession, path: str, run: str, level: str, samples: str, reading: str, predictors: list[str], n_samples: int, f1: float, vif: float | None = None) -> None:
    """Append a run; nothing that is there is changed."""
    spark.createDataFrame([(run, level, samples, reading, list(predictors), n_samples, vif, f1)], RUNS).coalesce(1).withColumn("recorded", F.current_timestamp()).write.mode("append").parquet(path)


def comparable_runs(runs: DataFrame, run: str) -> DataFrame:
    """The runs of the level and samples of a run (the latest of equal predictors), the most predictors first."""
    own = runs.where(F.col("run") == run).select(F.col("level").alias("l_"), F.col("samples").alias("s_")).distinct()
    same = runs.join(own, (runs["level"] == own["l_"]) & (runs["samples"] == own["s_"])).drop("l_", "s_")
    best = same.groupBy("level", "samples", "predictors").agg(F.max_by(F.struct("run", "reading", "n_samples", "vif", "f1"), F.struct("recorded", "run")).alias("r"))
    return best.select("r.run", "level", "samples", "r.reading", "predictors", F.size("predictors").alias("n_predictors"), "r.n_samples", "r.vif", "r.f1")


def compared_runs(runs: DataFrame, one: str, other: str) -> DataFrame:
    """One row: the gain in F1 of a run over another; ValueError where level, samples or reading differ, or a run is not there."""
    known = {r.run: r for r in runs.where(F.col("run").isin(one, other)).collect()}
    if lost := {one, other} - set(known):
        raise ValueError(f"no such run: {', '.join(sorted(lost))}")
    a, b = known[one], known[other]
    if wrong := [k for k in ("level", "samples", "reading") if a[k] != b[k]]:
        raise ValueError(f"{one} and {other} differ in {', '.join(wrong)}")
    return runs.sparkSession.createDataFrame([(one, other, a.f1, b.f1, a.f1 - b.f1)], "run string, other string, f1 double, other_f1 double, gain double")


def check_pair(first: dict, second: dict) -> None:
    """Two models make one map only if both descriptions name the same reading, and the first says meadow or not."""
    if first.get("reading") != second.get("reading"):
        raise ValueError("the models were trained on different readings")
    if len(first.get("classes", ())) != 2 or not first.get("absence", True):
        raise ValueError("the first model of a pair says meadow or not")
