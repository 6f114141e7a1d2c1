"""Queries of reviewed types, sample rules, thresholds from truth and self-training."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrafold.functions import labels
from terrafold.operators import decisions, evaluation, mapping, review
from terrafold.plans import views
from terrafold.plans.catalogue import PS, YES_NO, query, r6, six
from terrafold.plans.views import POINTS, PREDICTORS, SCENES, SCORED

KINDS = ["stream", "lake", "slope"]
SAMPLE = f"""s AS (SELECT point_id, CASE WHEN point_id % 97 = 0 THEN NULL ELSE x END AS x, {YES_NO} AS label, doubtful, point_id % 5 = 0 AS reviewed, CASE point_id % 4 WHEN 0 THEN 'stream' WHEN 1 THEN 'lake' WHEN 2 THEN 'slope' ELSE 'river' END AS kind,
 CASE WHEN proba >= 0.7 THEN 'PROBABLE' WHEN proba <= 0.2 THEN 'NO_MEADOW' ELSE 'UNCERTAIN' END AS decision FROM points)"""


def _samples(spark, sf_dir):
    k = F.col("point_id")
    kind = F.when(k % 4 == 0, F.lit("stream")).when(k % 4 == 1, F.lit("lake")).when(k % 4 == 2, F.lit("slope")).otherwise(F.lit("river"))
    decision = F.when(F.col("proba") >= 0.7, F.lit("PROBABLE")).when(F.col("proba") <= 0.2, F.lit("NO_MEADOW")).otherwise(F.lit("UNCERTAIN"))
    return views.points(spark, sf_dir).select(k, F.when(k % 97 != 0, F.col("x")).alias("x"), "y", labels.yes_no(F.col("raw_label")).alias("label"), "doubtful", (k % 5 == 0).alias("reviewed"), kind.alias("kind"), decision.alias("decision"))


@query(POINTS, SAMPLE, """SELECT point_id, CASE WHEN reason IS NULL THEN CASE WHEN reviewed THEN kind ELSE 'absence' END END AS category, reason FROM (SELECT *, CASE WHEN x IS NULL THEN 'no coordinates' WHEN reviewed AND label = 'no' THEN 'incoherent' WHEN doubtful THEN 'doubtful'
 WHEN reviewed AND kind = 'river' THEN 'invalid category' WHEN reviewed OR label = 'no' THEN NULL WHEN label = 'yes' OR decision = 'PROBABLE' THEN 'type not reviewed' ELSE 'no label' END AS reason FROM s)""")
def sample_reasons(spark, sf_dir):
    c = F.col
    found = review.sample_reason(c("x"), c("y"), c("label"), c("doubtful"), c("reviewed"), c("kind"), KINDS, c("decision"))
    return _samples(spark, sf_dir).select("point_id", found.alias("f")).select("point_id", "f.category", "f.reason")


@query(POINTS, SAMPLE, """SELECT point_id, CASE WHEN reason IS NULL THEN 'meadow' END AS category, reason FROM (SELECT *, CASE WHEN x IS NULL THEN 'no coordinates' WHEN reviewed AND label = 'no' THEN 'incoherent' WHEN doubtful THEN 'doubtful'
 WHEN reviewed OR label = 'yes' THEN NULL WHEN label = 'no' THEN 'absence not included' ELSE 'neither yes nor no' END AS reason FROM s)""")
def sample_reasons_yes_no(spark, sf_dir):
    c = F.col
    found = review.sample_reason(c("x"), c("y"), c("label"), c("doubtful"), c("reviewed"), c("kind"), KINDS, c("decision"), with_absence=False, yes_no=True)
    return _samples(spark, sf_dir).select("point_id", found.alias("f")).select("point_id", "f.category", "f.reason")


TYPED = """r AS (SELECT point_id, reviewed, decision = 'PROBABLE' AS meadow, kind AS setting, CASE WHEN point_id % 3 = 0 THEN 'wet' ELSE 'dry' END AS wetness, CASE WHEN point_id % 7 = 0 THEN 'lake' ELSE 'slope' END AS setting_proposed, 'wet' AS wetness_proposed FROM s),
i AS (SELECT *, CASE WHEN reviewed AND setting = 'river' THEN 'setting=river' END AS invalid FROM r), v AS (SELECT *, reviewed AND invalid IS NULL AS seen FROM i),
typed AS (SELECT point_id, invalid, seen AS reviewed, CASE WHEN seen THEN setting WHEN meadow THEN setting_proposed ELSE '' END AS setting, CASE WHEN seen THEN wetness WHEN meadow THEN wetness_proposed ELSE '' END AS wetness,
 CASE WHEN seen OR meadow THEN setting_proposed ELSE '' END AS setting_rule, CASE WHEN seen OR meadow THEN wetness_proposed ELSE '' END AS wetness_rule FROM v)"""
TWO = {k: review.LEVELS[k] for k in ("setting", "wetness")}


def _typed(spark, sf_dir):
    k = F.col("point_id")
    rows = _samples(spark, sf_dir).withColumnRenamed("kind", "setting").withColumns({
        "wetness": F.when(k % 3 == 0, F.lit("wet")).otherwise(F.lit("dry")), "setting_proposed": F.when(k % 7 == 0, F.lit("lake")).otherwise(F.lit("slope")), "wetness_proposed": F.lit("wet")})
    return review.apply_types(rows, TWO)


@query(POINTS, SAMPLE, TYPED, "SELECT * FROM typed")
def typology_population(spark, sf_dir):
    return _typed(spark, sf_dir).select("point_id", "invalid", "reviewed", "setting", "wetness", "setting_rule", "wetness_rule")


@query(POINTS, SAMPLE, TYPED, "SELECT point_id, CASE WHEN setting = '' OR wetness = '' THEN '' ELSE setting || ' · ' || wetness END AS category FROM typed")
def combined_level(spark, sf_dir):
    return _typed(spark, sf_dir).select("point_id", review.category(["setting", "wetness"]).alias("category"))


@query(POINTS, SAMPLE, TYPED, "SELECT point_id, CASE WHEN point_id % 11 = 0 THEN 'stream' ELSE setting END AS setting, CASE WHEN point_id % 11 = 0 AND wetness = '' THEN 'dry' ELSE wetness END AS wetness, reviewed OR point_id % 11 = 0 AS reviewed FROM typed")
def review_set(spark, sf_dir):
    rows = _typed(spark, sf_dir)
    chosen = rows.where("point_id % 11 = 0").select("point_id", F.lit("stream").alias("setting"), F.when(F.col("wetness") == "", F.lit("dry")).alias("wetness"))
    return review.set_review(rows, chosen, "point_id", TWO).select("point_id", "setting", "wetness", "reviewed")


@query(POINTS, SAMPLE, TYPED, "SELECT point_id, setting_rule AS setting, wetness_rule AS wetness, false AS reviewed FROM typed")
def review_clear(spark, sf_dir):
    return review.clear_review(_typed(spark, sf_dir), TWO).select("point_id", "setting", "wetness", "reviewed")


CUTS = """k AS (SELECT doc_id, truth AS t, round(score * 1000)::BIGINT AS k FROM scored), a AS (SELECT count_if(t = 1) AS p, count_if(t = 0) AS n FROM k),
j AS (SELECT c.k, count_if(k.k >= c.k AND t = 1) / any_value(p) - count_if(k.k >= c.k AND t = 0) / any_value(n) AS j FROM (SELECT DISTINCT k FROM k) c, k, a GROUP BY 1)"""


@query(SCORED, CUTS, "SELECT round(least(greatest(k / 1000, 0.3), 0.8), 6) + 0.0 AS threshold FROM j ORDER BY round(j, 9) DESC, k LIMIT 1")
def threshold_from_truth(spark, sf_dir):
    return six(review.threshold_from_truth(views.scored(spark, sf_dir), "truth", "score"), "threshold")


@query(SCORED, "SELECT round(least(greatest(quantile_cont(score, 0.1), 0.3), 0.8), 6) + 0.0 AS threshold FROM scored WHERE truth = 1")
def threshold_presence_only(spark, sf_dir):
    return six(review.threshold_from_truth(views.scored(spark, sf_dir).where("truth = 1"), "truth", "score"), "threshold")


@query(PREDICTORS, "g AS (SELECT CASE code % 3 WHEN 0 THEN 'pure' WHEN 1 THEN 'mixed-water' ELSE 'mixed-rock' END AS purity, least(greatest(((p1::FLOAT - (-0.5)::FLOAT)::FLOAT / (1.0)::FLOAT)::FLOAT, 0::FLOAT), 1::FLOAT) >= 0.5::FLOAT AS pure FROM tab WHERE p1 IS NOT NULL)",
       "SELECT purity, CASE WHEN pure THEN 'pure' ELSE 'mixed' END AS by_green, count(*) AS n FROM g GROUP BY ALL")
def purity_agreement(spark, sf_dir):
    k = F.col("code") % 3
    rows = views.predictors(spark, sf_dir).withColumn("purity", F.when(k == 0, F.lit("pure")).when(k == 1, F.lit("mixed-water")).otherwise(F.lit("mixed-rock")))
    return review.purity_agreement(rows, "purity", "p1", -0.5, 0.5, 0.5)


@query(POINTS, f"l AS (SELECT point_id, {YES_NO} AS label, proba, doubtful FROM points)", "p AS (SELECT *, label = 'yes' AND point_id % 2 = 0 AS base, (label = 'yes' OR (proba >= 0.7 AND NOT doubtful)) AND label <> 'no' AS pos FROM l)",
       """SELECT point_id AS id, CASE WHEN doubtful THEN 'doubtful' WHEN label = 'no' OR base THEN 'verified' WHEN pos THEN 'auto' ELSE 'predicted' END AS origin,
CASE WHEN doubtful OR label = 'no' THEN 'NO' WHEN base THEN 'VERIFIED_YES' WHEN pos THEN 'AUTO' ELSE 'NO' END AS decision FROM p""")
def training_origins(spark, sf_dir):
    rows = views.points(spark, sf_dir).select(F.col("point_id").alias("id"), labels.yes_no(F.col("raw_label")).alias("label"), "proba", "doubtful", F.lit("NO").alias("decision"))
    base = rows.where("label = 'yes' and id % 2 = 0").select("id")
    positives = rows.where("(label = 'yes' or (proba >= 0.7 and not doubtful)) and label <> 'no'").select("id")
    return review.origins(rows, base, positives).select("id", "origin", "decision")


@query(PREDICTORS, "p AS (SELECT vec_id, code, " + ", ".join(f"abs({c})::FLOAT AS {c}" for c in ("p1", "p2", "p4", "p5")) + " FROM tab), t AS (SELECT *, ((p1 + p2)::FLOAT + p4)::FLOAT AS total, greatest(p1, p2, p4) AS best FROM p), k AS (SELECT (range * 25)::INTEGER AS k FROM range(1, 40)), "
       "c AS (SELECT k / 1000.0 AS threshold, (code % 4) AS real, CASE WHEN total >= (k / 1000.0)::FLOAT THEN list_position([p1, p2, p4], best) ELSE 0 END AS said FROM t, k)",
       "SELECT round(threshold, 6) + 0.0 AS threshold, count(*) FILTER (real = said) AS n_right, count(*) FILTER (said > 0) AS n_meadow, count(*) AS n FROM c GROUP BY 1")
def rule_reapplied(spark, sf_dir):
    """Stored probabilities under every threshold of the two-step rule, without training again."""
    a = lambda c: F.abs(F.col(c)).cast("float")
    rows = views.predictors(spark, sf_dir).select((F.col("code") % 4).alias("real"), F.array(a("p5"), a("p1"), a("p2"), a("p4")).alias("p"))
    total, kind, _, _ = mapping.split_probabilities(F.col("p"))
    at = [k / 1000 for k in range(25, 976, 25)]
    said = lambda t: F.when(F.col("total") >= F.lit(t).cast("float"), F.col("kind")).otherwise(F.lit(0))
    rows = rows.withColumns({"total": total, "kind": kind})
    sums = rows.agg(*[x for i, t in enumerate(at) for x in (F.count_if(said(t) == F.col("real")).alias(f"r{i}"), F.count_if(said(t) > 0).alias(f"m{i}"))], F.count(F.lit(1)).alias("n"))
    each = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"r{i}").alias("n_right"), F.col(f"m{i}").alias("n_meadow"), "n") for i, t in enumerate(at)])
    return six(sums.select(F.inline(each)), "threshold")


@query(SCORED, "SELECT truth, predicted, count(*) AS n FROM scored WHERE truth <> predicted GROUP BY ALL ORDER BY 3 DESC, 1, 2 LIMIT 5")
def top_confusions(spark, sf_dir):
    return evaluation.confusion(views.scored(spark, sf_dir), "truth", "predicted").where("truth <> predicted").orderBy(F.desc("n"), "truth", "predicted").limit(5)


@query(SCORED, "c AS (SELECT doc_id % 5 AS fold, cls, count(*) FILTER (truth = cls AND predicted = cls) AS tp, count(*) FILTER (truth = cls) + count(*) FILTER (predicted = cls) AS sides, count(*) FILTER (truth = cls) AS support FROM scored, (SELECT unnest([0, 1]) AS cls) GROUP BY 1, 2)",
       f"SELECT fold, n, {r6('accuracy', 'macro_f1')} FROM (SELECT fold, sum(support)::BIGINT AS n, sum(tp) / sum(support) AS accuracy, avg(2 * tp / sides) AS macro_f1 FROM c WHERE sides > 0 GROUP BY 1)")
def fold_metrics(spark, sf_dir):
    return six(evaluation.fold_metrics(views.scored(spark, sf_dir).withColumn("fold", F.col("doc_id") % 5), "fold", "truth", "predicted"), "accuracy", "macro_f1")


SWEEP = """t AS (SELECT i / 1000.0::DOUBLE AS threshold, count(*) FILTER (score >= i / 1000.0::DOUBLE AND truth = 1) AS tp, count(*) FILTER (score >= i / 1000.0::DOUBLE AND truth = 0) AS fp, count(*) FILTER (score < i / 1000.0::DOUBLE AND truth = 1) AS fn, count(*) FILTER (score < i / 1000.0::DOUBLE AND truth = 0) AS tn FROM scored, (SELECT unnest(range(25, 976, 25)) AS i) GROUP BY i),
m AS (SELECT threshold, 2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0) AS f1, tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0) - 1 AS tss FROM t)"""


def _best(criterion: str) -> str:
    return f"""(SELECT '{criterion}' AS criterion, threshold, n AS run, best AS value FROM (SELECT avg(threshold) AS threshold, count(*) AS n, any_value(best) AS best FROM (SELECT threshold, best, i - row_number() OVER (ORDER BY threshold) AS island
 FROM (SELECT threshold, round({criterion}, 9) AS v, max(round({criterion}, 9)) OVER () AS best, row_number() OVER (ORDER BY threshold) AS i FROM m) WHERE v = best) GROUP BY island) ORDER BY n DESC, abs(threshold - 0.5), threshold LIMIT 1)"""


@query(SCORED, SWEEP, f"SELECT criterion, run, {r6('threshold', 'value')} FROM ({_best('f1')} UNION ALL {_best('tss')} UNION ALL (SELECT 'manual', 0.61, 1, f1 FROM m ORDER BY round(abs(threshold - 0.61), 9), threshold LIMIT 1))")
def threshold_choices(spark, sf_dir):
    """The cut by each criterion, and a manual one with the figures of its nearest threshold."""
    sweep = evaluation.threshold_sweep(views.scored(spark, sf_dir), "truth", "score")
    parts = [evaluation.chosen_threshold(sweep, c, 0.61).withColumn("criterion", F.lit(c)) for c in evaluation.CRITERIA]
    return six(parts[0].unionByName(parts[1]).unionByName(parts[2]), "threshold", "value")


@query(PREDICTORS, "i AS (SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS variable, {k} AS place, abs(corr({c}, code)) AS drop_mean, stddev_pop({c}) AS impurity FROM tab" for k, c in enumerate(PS)) + "))",
       f"SELECT variable, row_number() OVER (ORDER BY round(drop_mean, 9) DESC, round(impurity, 9) DESC, place)::INTEGER AS rank, {r6('drop_mean')} FROM i")
def importance_ranks(spark, sf_dir):
    t = views.predictors(spark, sf_dir)
    sums = t.agg(*[x for c in PS for x in (F.abs(F.corr(c, "code")).alias(f"d_{c}"), F.stddev_pop(c).alias(f"i_{c}"))])
    each = sums.select(F.inline(F.array(*[F.struct(F.lit(c).alias("variable"), F.lit(k).alias("place"), F.col(f"d_{c}").alias("drop_mean"), F.col(f"i_{c}").alias("impurity")) for k, c in enumerate(PS)])))
    return six(evaluation.importance_ranks(each, "drop_mean", "impurity", "place").select("variable", "rank", "drop_mean"), "drop_mean")


@query(SCENES, "SELECT scene_id, point_id, tried FROM (SELECT scene_id, point_id, year(ts) AS y, row_number() OVER (PARTITION BY point_id, year(ts) ORDER BY ts, scene_id)::INTEGER AS tried FROM scenes) WHERE tried <= 8")
def tried_scenes(spark, sf_dir):
    """At most eight scenes a point and year are tried, whether they turn out valid or not."""
    from terrafold.operators.observations import first_valid

    s = views.scenes(spark, sf_dir).withColumn("year", F.year("ts"))
    return first_valid(s, F.lit(True), ["point_id", "year"], ["ts", "scene_id"], 8).select("scene_id", "point_id", F.col("rank").cast("int").alias("tried"))


@query(POINTS, SCENES, """c AS (SELECT CAST(ts AS DATE) AS day, count(DISTINCT p.point_id) AS covered FROM scenes s JOIN points p ON abs(p.x - s.cloud * 200) <= 300 AND abs(p.y - s.value) <= 300 GROUP BY 1),
d AS (SELECT CAST(ts AS DATE) AS day, avg(cloud) AS cloud FROM scenes GROUP BY 1)""", "SELECT strftime(d.day, '%Y-%m-%d') AS day, coalesce(covered, 0) AS covered FROM d LEFT JOIN c USING (day) ORDER BY coalesce(covered, 0) DESC, round(cloud, 9), d.day LIMIT 1")
def best_covered_day(spark, sf_dir):
    """The day whose scenes cover most points, then the least cloudy one."""
    from terrafold.operators.observations import best_covered

    scenes = views.scenes(spark, sf_dir).select(F.to_date("ts").alias("day"), "cloud", (F.col("cloud") * 200 - 300.0).alias("x0"), (F.col("cloud") * 200 + 300.0).alias("x1"), (F.col("value") - 300).alias("y0"), (F.col("value") + 300).alias("y1"))
    p = views.points(spark, sf_dir).select(F.col("point_id").alias("from_id"), "x", "y")
    return best_covered(p, scenes, 600.0).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "covered")


@query(POINTS, "SELECT point_id FROM points WHERE proba * 1000 >= 300 AND proba * 1000 <= 700")
def elevation_band(spark, sf_dir):
    from terrafold.operators.samples import within_range

    return within_range(views.points(spark, sf_dir).withColumn("z", F.col("proba") * 1000), "z", 300.0, 700.0).select("point_id")


@query(POINTS, f"SELECT round(avg(x), 6) + 0.0 AS x, round(avg(y), 6) + 0.0 AS y FROM points")
def centroid(spark, sf_dir):
    return six(views.points(spark, sf_dir).agg(F.avg("x").alias("x"), F.avg("y").alias("y")), "x", "y")


@query(PREDICTORS, f"SELECT vec_id, {r6('p0', 'q1', 'q2')} FROM (SELECT vec_id, (1 - abs(p1))::FLOAT::DOUBLE AS p0, (abs(p1) * abs(p2))::FLOAT::DOUBLE AS q1, (abs(p1) * abs(p4))::FLOAT::DOUBLE AS q2 FROM tab)")
def two_models(spark, sf_dir):
    """Absence from one model and types from another, on the same rows."""
    p = mapping.combined(F.abs(F.col("p1")), F.array(F.abs(F.col("p2")), F.abs(F.col("p4"))))
    rows = views.predictors(spark, sf_dir).select("vec_id", p.alias("p"))
    return six(rows.select("vec_id", *[F.get("p", F.lit(i)).cast("double").alias(n) for i, n in enumerate(("p0", "q1", "q2"))]), "p0", "q1", "q2")


@query(POINTS, "d AS (SELECT point_id, CASE WHEN doubtful THEN 'DOUBTFUL' WHEN proba >= 0.7 THEN 'PROBABLE' WHEN proba >= 0.5 THEN 'POSSIBLE' WHEN proba <= 0.2 THEN 'VERIFIED_NO' ELSE 'UNCERTAIN' END AS d FROM points)",
       "SELECT point_id, CASE d WHEN 'DOUBTFUL' THEN '#E69100' WHEN 'PROBABLE' THEN '#2E7D32' WHEN 'POSSIBLE' THEN '#66BB6A' WHEN 'VERIFIED_NO' THEN '#8E0000' ELSE '#FFB74D' END AS colour, d IN ('PROBABLE', 'POSSIBLE') AS meadow FROM d")
def decision_colours(spark, sf_dir):
    p = F.col("proba")
    d = F.when(F.col("doubtful"), F.lit("DOUBTFUL")).when(p >= 0.7, F.lit("PROBABLE")).when(p >= 0.5, F.lit("POSSIBLE")).when(p <= 0.2, F.lit("VERIFIED_NO")).otherwise(F.lit("UNCERTAIN"))
    return views.points(spark, sf_dir).select("point_id", review.decision_colour(d).alias("colour"), review.says_meadow(d).alias("meadow"))


@query(SCENES, "p AS (SELECT point_id, scene_id % 20 AS scene, value, scene_id % 2 AS pol FROM scenes), s AS (SELECT point_id, pol, scene, 10 * log10(avg(value) FILTER (value > 0)) AS db FROM p GROUP BY ALL), a AS (SELECT point_id, pol, avg(db) AS m, stddev_pop(db) AS sd FROM s GROUP BY ALL)",
       f"SELECT point_id, {r6('vv_mean', 'vv_sd', 'vh_mean', 'vh_sd', 'ratio')} FROM (SELECT point_id, max(m) FILTER (pol = 0) AS vv_mean, max(sd) FILTER (pol = 0) AS vv_sd, max(m) FILTER (pol = 1) AS vh_mean, max(sd) FILTER (pol = 1) AS vh_sd, max(m) FILTER (pol = 0) - max(m) FILTER (pol = 1) AS ratio FROM a GROUP BY 1)")
def polarisation_ratio(spark, sf_dir):
    from terrafold.operators.observations import polarisation

    s = views.scenes(spark, sf_dir).withColumnRenamed("value", "power")
    part = lambda k: s.where(F.col("scene_id") % 2 == k).withColumn("scene_id", F.col("scene_id") % 20)
    names = ("vv_mean", "vv_sd", "vh_mean", "vh_sd", "ratio")
    return six(polarisation(part(0), part(1), ["point_id"]).select("point_id", *names), *names)


@query(SCENES, "b AS (SELECT point_id, CAST(ts AS DATE) AS day, value, row_number() OVER (PARTITION BY point_id, CAST(ts AS DATE) ORDER BY cloud DESC, scene_id) AS r FROM scenes)",
       f"SELECT point_id, days, {r6('mean', 'p10', 'sd')} FROM (SELECT point_id, count(value) AS days, avg(value) AS mean, quantile_cont(value, 0.1) AS p10, CASE WHEN count(value) >= 2 THEN stddev_pop(value) END AS sd FROM b WHERE r = 1 GROUP BY 1)")
def best_readings(spark, sf_dir):
    from terrafold.operators.observations import best_readings as best

    rows = views.scenes(spark, sf_dir).select("point_id", F.to_date("ts").alias("day"), F.col("scene_id").alias("reading"), F.col("cloud").alias("n_valid"), "value")
    return six(best(rows, ["point_id"], "value"), "mean", "p10", "sd")


@query(POINTS, f"l AS (SELECT point_id, x, y, doubtful, {YES_NO} AS raw FROM points), k AS (SELECT *, CASE WHEN raw = '?' THEN '' ELSE raw END AS label FROM l)",
       """SELECT point_id AS id, CASE WHEN doubtful THEN NULL WHEN label = 'yes' THEN 1.0 WHEN label = 'no' THEN 0.0
 WHEN NOT EXISTS (SELECT 1 FROM k p WHERE p.label = 'yes' AND sqrt((p.x - k.x) ** 2 + (p.y - k.y) ** 2) <= 250) THEN 0.0 END::DOUBLE AS code FROM k""")
def presence_labels(spark, sf_dir):
    from terrafold.operators.training import presence_labels as marked

    label = labels.yes_no(F.col("raw_label"))
    rows = views.points(spark, sf_dir).select(F.col("point_id").alias("id"), "x", "y", "doubtful", F.when(label == "?", F.lit("")).otherwise(label).alias("label"))
    return marked(rows).select("id", "code")
