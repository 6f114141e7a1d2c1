"""All queries over the driver tables, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.functions import geo, labels
from terrafold.operators import decisions, evaluation, hydrology, labelling, observations, profiles, quality, raster, samples, sequences, spatial, training
from terrafold.plans import views
from terrafold.plans.views import OBSERVATIONS, PIXELS, POINTS, PREDICTORS, SCENES, SCORED, TRUTH
from terrafold.sources.tables import table

FLAGSHIP = "decision_counts"
QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}
PS = [f"p{i}" for i in range(1, views.N_PREDICTORS + 1)]


def query(*parts: str):
    """Register a query; ``parts`` are view texts and, last, the SELECT. No parts: SQL doesn't say it."""

    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if parts:
            *with_, select = parts
            SQL[f.__name__] = (f"WITH RECURSIVE {', '.join(with_)} " if with_ else "") + select
        return f

    return register


def six(df: DataFrame, *names: str) -> DataFrame:
    """Doubles at six decimals, with no negative zero."""
    return df.withColumns({n: F.round(F.col(n), 6) + 0.0 for n in names})


def r6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) + 0.0 AS {n.rpartition('.')[2]}" for n in names)


# Observations

YEARLY = "yearly AS (SELECT point_id, season, year, median(ndvi) AS v FROM obs GROUP BY ALL), seasonal AS (SELECT point_id, season, median(v) AS ndvi FROM yearly GROUP BY ALL)"


@query(OBSERVATIONS, YEARLY, """wide AS (SELECT p_partkey AS point_id, max(ndvi) FILTER (season = 'late') AS late FROM part LEFT JOIN seasonal ON point_id = p_partkey GROUP BY 1),
d AS (SELECT CASE WHEN late IS NULL THEN 'NO_DATA' WHEN (late + 1) / 2 >= 0.70 THEN 'PROBABLE' WHEN (late + 1) / 2 >= 0.5 THEN 'POSSIBLE' WHEN (late + 1) / 2 <= 0.20 THEN 'NO' ELSE 'UNCERTAIN' END AS decision FROM wide)""",
       "SELECT decision, count(*) AS n FROM d GROUP BY 1")
def decision_counts(spark, sf_dir):
    """From raw observations to decisions: mask, index, median of yearly medians, rule, count."""
    seasonal = observations.median_of_yearly_medians(views.observations(spark, sf_dir), ["ndvi"]).where("season = 'late'")
    points = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("point_id")).join(seasonal, "point_id", "left")
    none = F.lit(None).cast("string")
    return decisions.decision_counts(points.withColumn("decision", decisions.decide((F.col("ndvi") + 1) / 2, none, F.lit(False))))


@query(OBSERVATIONS, "y AS (SELECT point_id, season, year, median(ndvi) AS ndvi, median(ndwi) AS ndwi, median(ndmi) AS ndmi FROM obs GROUP BY ALL)",
       f"SELECT point_id, season, {r6('ndvi', 'ndwi', 'ndmi')} FROM (SELECT point_id, season, median(ndvi) AS ndvi, median(ndwi) AS ndwi, median(ndmi) AS ndmi FROM y GROUP BY ALL)")
def seasonal_median(spark, sf_dir):
    return six(observations.median_of_yearly_medians(views.observations(spark, sf_dir), ["ndvi", "ndwi", "ndmi"]), "ndvi", "ndwi", "ndmi")


@query(OBSERVATIONS, f"SELECT point_id, n, {r6('mean', 'min', 'max', 'sd')} FROM (SELECT point_id, count(ndmi) AS n, avg(ndmi) AS mean, min(ndmi) AS min, max(ndmi) AS max, stddev_pop(ndmi) AS sd FROM obs GROUP BY 1)")
def period_stats_pooled(spark, sf_dir):
    return six(observations.pooled_stats(views.observations(spark, sf_dir), "ndmi", ["point_id"]), "mean", "min", "max", "sd")


@query(OBSERVATIONS, "y AS (SELECT point_id, year, avg(ndmi) AS mean, min(ndmi) AS min, max(ndmi) AS max, CASE WHEN count(ndmi) >= 2 THEN stddev_pop(ndmi) END AS sd FROM obs GROUP BY ALL)",
       f"SELECT point_id, {r6('mean', 'min', 'max', 'sd')}, years FROM (SELECT point_id, avg(mean) AS mean, avg(min) AS min, avg(max) AS max, avg(sd) AS sd, count(*) AS years FROM y GROUP BY 1)")
def period_stats_yearly(spark, sf_dir):
    return six(observations.yearly_stats(views.observations(spark, sf_dir), "ndmi", ["point_id"]), "mean", "min", "max", "sd")


@query(OBSERVATIONS, "m AS (SELECT point_id, season, median(b8) AS b8, median(b4) AS b4 FROM obs GROUP BY ALL)",
       "SELECT point_id, season, round((b8 - b4) / (b8 + b4 + 1e-6), 6) + 0.0 AS ndvi FROM m")
def composite_then_index(spark, sf_dir):
    from terrafold.functions.indices import ndvi

    bands = observations.composite(views.observations(spark, sf_dir), ["b8", "b4"], ["point_id", "season"])
    return six(bands.select("point_id", "season", ndvi(F.col("b8"), F.col("b4")).alias("ndvi")), "ndvi")


@query(SCENES, "SELECT point_id, scene_id, cloud, rank FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY ts, scene_id) AS rank FROM scenes WHERE cloud < 40) WHERE rank <= 8")
def first_valid_scenes(spark, sf_dir):
    return observations.first_valid(views.scenes(spark, sf_dir), F.col("cloud") < 40, ["point_id"], ["ts", "scene_id"], 8).select("point_id", "scene_id", "cloud", F.col("rank").cast("long").alias("rank"))


@query(SCENES, """SELECT a.scene_id, round(avg(b.cloud), 6) + 0.0 AS near_mean, count(b.cloud) AS near_n FROM scenes a LEFT JOIN scenes b
ON a.point_id = b.point_id AND b.ts BETWEEN a.ts - INTERVAL 1 DAY AND a.ts + INTERVAL 1 DAY GROUP BY 1""")
def cloud_interval_join(spark, sf_dir):
    s = views.scenes(spark, sf_dir)
    near = observations.interval_mean(s.select("scene_id", "point_id", "ts"), s, "point_id", "ts", "cloud")
    return six(near.select("scene_id", "near_mean", "near_n"), "near_mean")


@query(SCENES, """d AS (SELECT point_id, CAST(ts AS DATE) AS day, count(*) AS n, avg(cloud) AS cloud FROM scenes GROUP BY ALL)""",
       "SELECT point_id, strftime(day, '%Y-%m-%d') AS day, n, round(cloud, 6) + 0.0 AS cloud FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY n DESC, -round(cloud, 9) DESC, day) AS r FROM d) WHERE r = 1")
def best_day(spark, sf_dir):
    days = views.scenes(spark, sf_dir).groupBy("point_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.avg("cloud").alias("cloud"))
    return six(observations.best_day(days, ["point_id"], "day", [F.col("n"), -F.round("cloud", 9)]).withColumn("day", F.date_format("day", "yyyy-MM-dd")), "cloud")


@query(SCENES, "s AS (SELECT point_id, scene_id % 20 AS scene, avg(value) FILTER (value > 0) AS p FROM scenes GROUP BY ALL)",
       f"SELECT point_id, {r6('db_mean', 'db_sd')} FROM (SELECT point_id, avg(10 * log10(p)) AS db_mean, stddev_pop(10 * log10(p)) AS db_sd FROM s GROUP BY 1)")
def backscatter_stats(spark, sf_dir):
    s = views.scenes(spark, sf_dir).withColumn("scene_id", F.col("scene_id") % 20)
    return six(observations.backscatter(s, ["point_id"], "value"), "db_mean", "db_sd")


@query(SCENES, "SELECT point_id, CAST(ts AS DATE)::VARCHAR AS day, count(*) AS n, count(*) FILTER (WHERE cls IN ('click', 'view')) AS n_clear FROM scenes GROUP BY ALL HAVING count_if(cls IN ('click', 'view')) >= 0.5 * count(*)")
def clear_windows(spark, sf_dir):
    s = views.scenes(spark, sf_dir).withColumn("day", F.to_date("ts").cast("string"))
    return observations.window_votes(s, ["point_id", "day"], F.col("cls").isin("click", "view"))


# Labels and decisions

YES_NO = "CASE WHEN raw_label IS NULL OR raw_label = '' THEN '' WHEN raw_label IN ('Sí', '1') THEN 'yes' WHEN raw_label = 'no' THEN 'no' ELSE '?' END"


@query(POINTS, f"SELECT point_id, {YES_NO} AS label, CASE WHEN {YES_NO} IN ('yes', 'no') THEN {YES_NO} ELSE 'yes' END AS truth FROM points")
def label_values(spark, sf_dir):
    return views.points(spark, sf_dir).select("point_id", labels.yes_no(F.col("raw_label")).alias("label"), labels.truth_label(F.col("raw_label")).alias("truth"))


@query(POINTS, f"""SELECT 'raw_label' AS name, 0 AS priority, count(*) FILTER (WHERE {YES_NO} <> '') AS filled, count(*) FILTER (WHERE {YES_NO} IN ('yes', 'no')) AS understood FROM points
UNION ALL SELECT 'segment', 1, count(*), 0 FROM points""")
def label_columns(spark, sf_dir):
    return labelling.column_quality(views.points(spark, sf_dir), ["raw_label", "segment"])


@query(POINTS, "SELECT segment AS value, count(*) AS n FROM points GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8")
def unknown_values(spark, sf_dir):
    return labelling.unknown_values(views.points(spark, sf_dir), "segment")


@query(POINTS, f"""l AS (SELECT *, {YES_NO} AS label FROM points), d AS (SELECT CASE WHEN doubtful THEN 'DOUBTFUL' WHEN label = 'yes' AND point_id % 3 = 0 THEN 'VERIFIED_YES'
 WHEN label = 'no' AND point_id % 3 = 0 THEN 'VERIFIED_NO' WHEN proba >= 0.7 THEN 'PROBABLE' WHEN proba >= 0.5 THEN 'POSSIBLE' WHEN proba <= 0.2 THEN 'NO' ELSE 'UNCERTAIN' END AS decision FROM l)""",
       "SELECT decision, count(*) AS n FROM d GROUP BY 1")
def point_decisions(spark, sf_dir):
    p = views.points(spark, sf_dir)
    label = F.when(F.col("point_id") % 3 == 0, labels.yes_no(F.col("raw_label")))
    return decisions.decision_counts(p.withColumn("decision", decisions.decide(F.col("proba"), label, F.col("doubtful"))))


@query(POINTS, TRUTH, f"""near AS (SELECT ord, point_id, label, row_number() OVER (PARTITION BY ord ORDER BY sqrt((t.x - p.x) ** 2 + (t.y - p.y) ** 2), point_id) AS r
 FROM truth t, points p WHERE sqrt((t.x - p.x) ** 2 + (t.y - p.y) ** 2) <= 20),
hit AS (SELECT * FROM near WHERE r = 1), last AS (SELECT point_id, max_by(label, ord) AS t FROM hit GROUP BY 1)""",
       f"""SELECT p.point_id::VARCHAR AS id, coalesce(t, {YES_NO}) AS label, CASE WHEN t IS NULL THEN 'candidate' ELSE 'matched' END AS origin FROM points p LEFT JOIN last USING (point_id)
UNION ALL SELECT 't' || ord, label, 'truth' FROM truth WHERE ord NOT IN (SELECT ord FROM hit)""")
def truth_upsert(spark, sf_dir):
    p = views.points(spark, sf_dir).select(F.col("point_id").alias("id"), "x", "y", labels.yes_no(F.col("raw_label")).alias("label"))
    merged = labelling.merge_truth(p.withColumn("id", F.col("id").cast("string")), views.truth(spark, sf_dir))
    return merged.select("id", "label", "origin")


# Space

@query(POINTS, TRUTH, "SELECT point_id, round(min(sqrt((t.x - p.x) ** 2 + (t.y - p.y) ** 2)), 6) + 0.0 AS d FROM points p, truth t GROUP BY 1")
def lake_distance(spark, sf_dir):
    p = views.points(spark, sf_dir).select(F.col("point_id").alias("from_id"), "x", "y")
    d = spatial.nearest_distance(p, views.truth(spark, sf_dir).select(F.col("ord").alias("id"), "x", "y"), 250.0)
    return six(d.withColumnRenamed("from_id", "point_id"), "d")


@query(POINTS, TRUTH, "SELECT point_id FROM points p WHERE NOT EXISTS (SELECT 1 FROM truth t WHERE t.label = 'yes' AND sqrt((t.x - p.x) ** 2 + (t.y - p.y) ** 2) < 250)")
def pseudo_absence(spark, sf_dir):
    p = views.points(spark, sf_dir).select(F.col("point_id").alias("from_id"), "x", "y")
    positives = views.truth(spark, sf_dir).where("label = 'yes'").select(F.col("ord").alias("to_id"), "x", "y")
    return spatial.far_from(p, positives, 250.0).select(F.col("from_id").alias("point_id"))


@query(POINTS, "SELECT point_id, floor(x / 10) * 10 + 5.0 AS sx, floor(y / 10) * 10 + 5.0 AS sy FROM points")
def snap_grid(spark, sf_dir):
    return views.points(spark, sf_dir).select("point_id", geo.snap(F.col("x")).cast("double").alias("sx"), geo.snap(F.col("y")).cast("double").alias("sy"))


@query(POINTS, "SELECT min(x) - 500.0 AS min_x, min(y) - 500.0 AS min_y, max(x) + 500.0 AS max_x, max(y) + 500.0 AS max_y FROM points")
def bounding_box(spark, sf_dir):
    return spatial.bounding_box(views.points(spark, sf_dir), 500.0)


@query(POINTS, "SELECT count(*) AS cells, count(*) * 4.0 AS area FROM (SELECT DISTINCT floor(x / 2000), floor(y / 2000) FROM points)")
def occupied_cells(spark, sf_dir):
    return spatial.occupied_cells(views.points(spark, sf_dir), 2000.0, 2000.0, 4.0)


RING = [(1000.5, 120.5), (15000.5, 80.5), (9000.5, 900.5), (14000.5, 1500.5), (2000.5, 1300.5)]


@query(POINTS, "e(x1, y1, x2, y2) AS (VALUES " + ", ".join(f"({a[0]}, {a[1]}, {b[0]}, {b[1]})" for a, b in zip(RING, RING[1:] + RING[:1])) + ")",
       "SELECT point_id FROM points, e GROUP BY 1 HAVING count_if((y1 > y) <> (y2 > y) AND x1 + (y - y1) * (x2 - x1) / CASE WHEN y2 = y1 THEN 1 ELSE y2 - y1 END > x) % 2 = 1")
def point_in_polygon(spark, sf_dir):
    p = views.points(spark, sf_dir).select(F.col("point_id").alias("from_id"), "x", "y")
    edges = spark.createDataFrame([(1, *a, *b) for a, b in zip(RING, RING[1:] + RING[:1])], "polygon int, ax double, ay double, bx double, by double")
    return spatial.inside_polygons(p, edges, 500.0).select(F.col("from_id").alias("point_id"))


@query(POINTS, """r(region, priority, x1, y1, x2, y2) AS (VALUES ('west', 1, 0.0, 0.0, 8000.0, 5000.0), ('middle', 2, 6000.0, 0.0, 16000.0, 5000.0)),
m AS (SELECT point_id, region, row_number() OVER (PARTITION BY point_id ORDER BY priority NULLS LAST) AS k FROM points LEFT JOIN r ON x BETWEEN x1 AND x2 AND y BETWEEN y1 AND y2)""", "SELECT point_id, region FROM m WHERE k = 1")
def first_region(spark, sf_dir):
    regions = spark.createDataFrame([("west", 1, 0.0, 0.0, 8000.0, 5000.0), ("middle", 2, 6000.0, 0.0, 16000.0, 5000.0)], "region string, priority int, min_x double, min_y double, max_x double, max_y double")
    p = views.points(spark, sf_dir).select(F.col("point_id").alias("from_id"), "x", "y")
    return spatial.first_region(p, regions).select(F.col("from_id").alias("point_id"), "region")


@query(POINTS, "b AS (SELECT point_id, least(floor((proba - min(proba) OVER ()) * 5 / (max(proba) OVER () - min(proba) OVER ())), 4)::INTEGER AS band FROM points)",
       "SELECT point_id, band FROM (SELECT *, row_number() OVER (PARTITION BY band ORDER BY (point_id * 7919) % 10007, point_id) AS r FROM b) WHERE r <= 20")
def stratified_bands(spark, sf_dir):
    return spatial.bands(views.points(spark, sf_dir), "proba", 5, 20, [(F.col("point_id") * 7919) % 10007, "point_id"]).select("point_id", "band")


# Samples and training tables

@query(POINTS, f"""c AS (SELECT point_id, {YES_NO} AS label, doubtful, CASE WHEN point_id % 5 > 0 THEN point_id % 5 END AS category FROM points)""",
       """SELECT coalesce(reason, 'used') AS reason, count(*) AS n FROM (SELECT CASE WHEN doubtful THEN 'doubtful' WHEN label = 'no' THEN NULL WHEN label = '?' THEN 'label not understood'
WHEN label = 'yes' AND category IS NULL THEN 'no category' WHEN label = 'yes' THEN NULL ELSE 'no label' END AS reason FROM c) GROUP BY 1""")
def exclusion_counts(spark, sf_dir):
    k = F.col("point_id") % 5
    e = samples.eligibility(labels.yes_no(F.col("raw_label")), F.col("doubtful"), F.when(k > 0, k), F.lit(False))
    return views.points(spark, sf_dir).select(e.alias("e")).groupBy(F.coalesce("e.reason", F.lit("used")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(POINTS, """c AS (SELECT point_id, floor(x / 500) AS px, floor(y / 500) AS py, (point_id // 3) % 2 AS cat FROM points),
w AS (SELECT point_id, min(cat) OVER (PARTITION BY px, py) <> max(cat) OVER (PARTITION BY px, py) AS conflict, row_number() OVER (PARTITION BY px, py ORDER BY point_id) AS r FROM c)""",
       "SELECT point_id, CASE WHEN conflict THEN 'conflict' WHEN r > 1 THEN 'duplicate' END AS pixel_reason FROM w")
def pixel_dedup(spark, sf_dir):
    p = views.points(spark, sf_dir).select("point_id", F.floor(F.col("x") / 500).alias("px"), F.floor(F.col("y") / 500).alias("py"), (F.floor(F.col("point_id") / 3) % 2).alias("cat"))
    return samples.same_pixel(p, ["px", "py"], "cat", "point_id").select("point_id", "pixel_reason")


@query(PREDICTORS, """k AS (SELECT range::INTEGER AS code FROM range(12))""", "SELECT k.code, count(vec_id) AS n, CASE WHEN count(vec_id) < 5 THEN 'error' WHEN count(vec_id) < 30 THEN 'warning' ELSE 'ok' END AS state FROM k LEFT JOIN tab ON tab.code = k.code GROUP BY 1")
def class_counts(spark, sf_dir):
    classes = spark.range(12).select(F.col("id").cast("int").alias("code"))
    return samples.class_counts(views.predictors(spark, sf_dir), classes, "code").withColumn("state", samples.sufficiency(F.col("n")))


@query(PREDICTORS, "SELECT vec_id, CASE WHEN vec_id % 13 = 0 THEN 'not read' WHEN p3 IS NULL THEN 'no value' END AS reason, CASE WHEN p3 IS NULL THEN 'p3' ELSE '' END AS missing FROM tab")
def training_table(spark, sf_dir):
    t = samples.completeness(views.predictors(spark, sf_dir), PS, F.col("vec_id") % 13 != 0)
    return t.select("vec_id", "reason", F.array_join("missing", ",").alias("missing"))


@query(PREDICTORS, "c AS (SELECT min(n) AS m FROM (SELECT count(*) AS n FROM tab GROUP BY code))", "SELECT vec_id, code FROM (SELECT vec_id, code, row_number() OVER (PARTITION BY code ORDER BY (vec_id * 7919) % 10007, vec_id) AS r FROM tab) WHERE r <= (SELECT greatest(m, floor(m * 1.1)) FROM c)")
def undersample(spark, sf_dir):
    return samples.undersample(views.predictors(spark, sf_dir), "code", 1.1, [(F.col("vec_id") * 7919) % 10007, "vec_id"]).select("vec_id", "code")


@query(POINTS, "g AS (SELECT basin, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, basin) - 1 AS k FROM points GROUP BY 1)",
       "SELECT basin, n, (CASE WHEN (k // 5) % 2 = 0 THEN k % 5 ELSE 4 - k % 5 END)::INTEGER AS fold FROM g")
def group_folds(spark, sf_dir):
    return samples.group_folds(views.points(spark, sf_dir), "basin", 5)


@query(PREDICTORS, "m AS (SELECT median(p3) AS m FROM tab)", "SELECT vec_id, round(coalesce(p3, m), 6) + 0.0 AS p3 FROM tab, m")
def median_imputed(spark, sf_dir):
    return six(samples.median_imputed(views.predictors(spark, sf_dir), ["p3"]).select("vec_id", "p3"), "p3")


# Quality

PAIRS = [(a, b) for i, a in enumerate(PS) for b in PS[i + 1 :]]


@query(PREDICTORS, " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) + 0.0 AS r FROM tab" for a, b in PAIRS))
def correlations(spark, sf_dir):
    return six(quality.correlations(views.predictors(spark, sf_dir), PS), "r")


@query(PREDICTORS, "v AS (" + " UNION ALL ".join(f"SELECT '{c}' AS col, round({e}, 6) AS value FROM tab" for c, e in (("p1", "p1"), ("p3", "p3"), ("flat", "7.0::DOUBLE"))) + "), c AS (SELECT col, value, count(*) AS n FROM v WHERE value IS NOT NULL GROUP BY ALL)",
       """SELECT col AS "column", sum(n)::BIGINT AS n, count(*) AS distinct_values, round(max(n) / sum(n), 6) + 0.0 AS top_share, CASE WHEN count(*) = 1 THEN 'constant' WHEN sum(n) >= 20 AND max(n) / sum(n) >= 0.95 THEN 'nearly constant' END AS finding FROM c GROUP BY 1""")
def column_findings(spark, sf_dir):
    rows = views.predictors(spark, sf_dir).select("p1", "p3", F.lit(7.0).alias("flat"))
    return six(quality.findings(rows, ["p1", "p3", "flat"]), "top_share")


@query(PREDICTORS, "c AS (SELECT code, count(*) AS n FROM tab GROUP BY 1)", "SELECT max(n) AS largest, min(n) AS smallest, round(max(n) / min(n), 6) + 0.0 AS ratio FROM c")
def imbalance(spark, sf_dir):
    return six(quality.imbalance(views.predictors(spark, sf_dir), "code"), "ratio")


@query(PREDICTORS, """SELECT 'first' AS "group", count(p1) AS with_value, round(count(p1) / count(*), 6) + 0.0 AS share, 'good' AS flag FROM tab
UNION ALL SELECT 'third', count(p3), round(count(p3) / count(*), 6) + 0.0, CASE WHEN count(p3) / count(*) >= 0.8 THEN 'good' WHEN count(p3) / count(*) >= 0.3 THEN 'partial' ELSE 'poor' END FROM tab""")
def coverage(spark, sf_dir):
    return six(quality.coverage(views.predictors(spark, sf_dir), {"first": ["p1", "p2"], "third": ["p3"]}), "share")


# Evaluation

@query(SCORED, "t AS (SELECT (range * 25)::INTEGER AS k FROM range(1, 40))", """SELECT threshold, tp, fp, fn, tn, round(tp / (tp + fn), 6) + 0.0 AS sensitivity, round(tn / (tn + fp), 6) + 0.0 AS specificity, round(tp / nullif(tp + fp, 0), 6) + 0.0 AS "precision",
round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) + 0.0 AS f1, round(tp / (tp + fn) + tn / (tn + fp) - 1, 6) + 0.0 AS tss FROM (
SELECT k / 1000.0 AS threshold, count(*) FILTER (WHERE score >= k / 1000.0 AND truth = 1) AS tp, count(*) FILTER (WHERE score >= k / 1000.0 AND truth = 0) AS fp, count(*) FILTER (WHERE score < k / 1000.0 AND truth = 1) AS fn, count(*) FILTER (WHERE score < k / 1000.0 AND truth = 0) AS tn FROM scored, t GROUP BY 1)""")
def threshold_sweep(spark, sf_dir):
    return six(evaluation.threshold_sweep(views.scored(spark, sf_dir), "truth", "score"), "sensitivity", "specificity", "precision", "f1", "tss")


@query(SCORED, """t AS (SELECT (range * 25)::INTEGER AS k FROM range(1, 40)), c AS (SELECT k / 1000.0 AS threshold, count(*) FILTER (WHERE score >= k / 1000.0 AND truth = 1) AS tp, count(*) FILTER (WHERE score >= k / 1000.0 AND truth = 0) AS fp, count(*) FILTER (WHERE score < k / 1000.0 AND truth = 1) AS fn FROM scored, t GROUP BY 1),
f AS (SELECT threshold, round(2 * tp / nullif(2 * tp + fp + fn, 0), 9) AS v, row_number() OVER (ORDER BY threshold) AS i FROM c),
b AS (SELECT threshold, v, i - row_number() OVER (ORDER BY threshold) AS g FROM f WHERE v = (SELECT max(v) FROM f))""",
       'SELECT round(avg(threshold), 6) + 0.0 AS threshold, count(*) AS run, round(max(v), 6) + 0.0 AS value FROM b GROUP BY g ORDER BY count(*) DESC, abs(avg(threshold) - 0.5), 1 LIMIT 1')
def best_threshold_run(spark, sf_dir):
    return six(evaluation.best_threshold(evaluation.threshold_sweep(views.scored(spark, sf_dir), "truth", "score")), "threshold", "value")


@query(SCORED, """c AS (SELECT score AS s, count_if(truth = 1) AS p, count_if(truth = 0) AS n FROM scored GROUP BY 1), w AS (SELECT s, sum(p) OVER (ORDER BY s DESC) / sum(p) OVER () - sum(n) OVER (ORDER BY s DESC) / sum(n) OVER () AS j FROM c)""",
       "SELECT s AS threshold, round(j, 6) + 0.0 AS j FROM w ORDER BY round(j, 9) DESC, s DESC LIMIT 1")
def youden(spark, sf_dir):
    return six(evaluation.youden(views.scored(spark, sf_dir), "truth", "score"), "j")


@query(SCORED, """c AS (SELECT score AS s, count_if(truth = 1) AS p, count_if(truth = 0) AS n FROM scored GROUP BY 1), w AS (SELECT *, coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM c)""",
       "SELECT sum(p)::BIGINT AS n_pos, sum(n)::BIGINT AS n_neg, round(sum(p * (b + n / 2.0)) / (sum(p) * sum(n)), 6) + 0.0 AS auc FROM w")
def auc_rank(spark, sf_dir):
    return six(evaluation.auc(views.scored(spark, sf_dir), "truth", "score"), "auc")


@query(SCORED, """s AS (SELECT min(score) AS lo, max(score) AS hi, count(*) AS total FROM scored), h AS (SELECT least(floor((score - lo) / (hi - lo) * 256), 255) AS bin, count(*) AS n, any_value(lo) AS lo, any_value(hi) AS hi, any_value(total) AS total FROM scored, s GROUP BY 1),
m AS (SELECT *, lo + (bin + 0.5) * (hi - lo) / 256 AS c FROM h), w AS (SELECT *, sum(n) OVER (ORDER BY bin) AS w0, sum(n * c) OVER (ORDER BY bin) AS m0, sum(n * c) OVER () AS m1 FROM m)""",
       "SELECT round(least(greatest(c, 0.3), 0.8), 6) + 0.0 AS threshold FROM w WHERE w0 < total ORDER BY round(w0 * (total - w0) * (m0 / w0 - (m1 - m0) / (total - w0)) ** 2 / total ** 2, 9) DESC, bin LIMIT 1")
def otsu(spark, sf_dir):
    return six(evaluation.otsu(views.scored(spark, sf_dir), "score"), "threshold")


@query(SCORED, "SELECT lang, truth, predicted, count(*) AS n FROM scored GROUP BY ALL")
def confusion_by_lang(spark, sf_dir):
    return views.scored(spark, sf_dir).groupBy("lang", "truth", "predicted").agg(F.count(F.lit(1)).alias("n"))


@query(SCORED, """k(class) AS (VALUES (0), (1)), m AS (SELECT class, count(*) FILTER (WHERE truth = class) AS support, count(*) FILTER (WHERE predicted = class) AS predicted, count(*) FILTER (WHERE truth = class AND predicted = class) AS tp FROM scored, k GROUP BY 1)""",
       'SELECT class, support, predicted, tp, round(tp / predicted, 6) + 0.0 AS "precision", round(tp / support, 6) + 0.0 AS recall, round(2 * tp / (support + predicted), 6) + 0.0 AS f1 FROM m')
def per_class_metrics(spark, sf_dir):
    matrix = evaluation.confusion(views.scored(spark, sf_dir), "truth", "predicted")
    return six(evaluation.class_metrics(matrix, "truth", "predicted"), "precision", "recall", "f1")


@query(SCORED, """k(class) AS (VALUES (0), (1)), m AS (SELECT class, count(*) FILTER (WHERE truth = class) AS s, count(*) FILTER (WHERE predicted = class) AS p, count(*) FILTER (WHERE truth = class AND predicted = class) AS tp FROM scored, k GROUP BY 1)""",
       "SELECT round(sum(tp) / sum(s), 6) + 0.0 AS accuracy, round(avg(tp / s), 6) + 0.0 AS balanced_accuracy, round(avg(2 * tp / (s + p)), 6) + 0.0 AS macro_f1, sum(s)::BIGINT AS n FROM m")
def summary_metrics(spark, sf_dir):
    matrix = evaluation.confusion(views.scored(spark, sf_dir), "truth", "predicted")
    return six(evaluation.summary_metrics(evaluation.class_metrics(matrix, "truth", "predicted")), "accuracy", "balanced_accuracy", "macro_f1")


@query(PREDICTORS, "a AS (SELECT vec_id, list_transform([p1, p2, p4, p5], lambda v: abs(v)::FLOAT) AS t, abs(p6)::FLOAT AS z FROM tab)",
       "SELECT vec_id, CASE WHEN list_max(t) > z THEN list_position(t, list_max(t)) ELSE 0 END::INTEGER AS class FROM a")
def two_step_decide(spark, sf_dir):
    t = views.predictors(spark, sf_dir)
    types = F.array(*[F.abs(F.col(c)).cast("float") for c in ("p1", "p2", "p4", "p5")])
    return t.select("vec_id", decisions.two_step(types, F.abs(F.col("p6")).cast("float"), None).alias("class"))


# Profiles

@query(PREDICTORS, "v AS (UNPIVOT (SELECT code, p1, p2, p3 FROM tab) ON p1, p2, p3 INTO NAME variable VALUE value)",
       "SELECT code, variable, count(*) AS n, " + ", ".join(f"round(quantile_cont(value, {q}), 6) + 0.0 AS p{round(q * 100)}" for q in (0.1, 0.25, 0.5, 0.75, 0.9)) + " FROM v GROUP BY ALL HAVING count(*) >= 10")
def class_percentiles(spark, sf_dir):
    return six(profiles.class_percentiles(views.predictors(spark, sf_dir), "code", ["p1", "p2", "p3"]), "p10", "p25", "p50", "p75", "p90")


@query(PREDICTORS, "q AS (SELECT code, min(p1) AS low, max(p1) AS high, count(p1) AS n, quantile_cont(p1, 0.25) AS q1, quantile_cont(p1, 0.5) AS median, quantile_cont(p1, 0.75) AS q3 FROM tab GROUP BY 1)",
       f"SELECT code, 'p1' AS variable, n, {r6('low', 'high', 'q1', 'median', 'q3')}, round(greatest(low, q1 - 1.5 * (q3 - q1)), 6) + 0.0 AS whisker_low, round(least(high, q3 + 1.5 * (q3 - q1)), 6) + 0.0 AS whisker_high FROM q")
def boxplot_stats(spark, sf_dir):
    return six(profiles.boxplot(views.predictors(spark, sf_dir), "code", ["p1"]), "low", "high", "q1", "median", "q3", "whisker_low", "whisker_high")


@query(PREDICTORS, "q AS (SELECT code, " + ", ".join(f"quantile_cont(p1, {p / 100}) AS p{p}" for p in (10, 25, 50, 75, 90)) + " FROM tab GROUP BY 1 HAVING count(p1) >= 10)",
       """SELECT vec_id, code, round(CASE WHEN p1 < p10 THEN 5 WHEN p1 <= p25 THEN 10 + 15 * (p1 - p10) / (p25 - p10) WHEN p1 <= p50 THEN 25 + 25 * (p1 - p25) / (p50 - p25)
 WHEN p1 <= p75 THEN 50 + 25 * (p1 - p50) / (p75 - p50) WHEN p1 <= p90 THEN 75 + 15 * (p1 - p75) / (p90 - p75) ELSE 95 END, 6) + 0.0 AS "position", p1 BETWEEN p25 AND p75 AS inside FROM tab JOIN q USING (code)""")
def percentile_position(spark, sf_dir):
    t = views.predictors(spark, sf_dir)
    return six(profiles.percentile_position(t, "vec_id", "code", profiles.class_percentiles(t, "code", ["p1"]), ["p1"]).select("vec_id", "code", "position", "inside"), "position")


@query(POINTS, "SELECT least(floor(round(proba / 0.05, 9)), 19)::INTEGER AS bin, count(*) AS n FROM points GROUP BY 1")
def prob_histogram(spark, sf_dir):
    return profiles.histogram(views.points(spark, sf_dir), "proba", 0.05)


@query(SCORED, "SELECT lang, source, truth, count(*) AS n, grouping(lang, source, truth)::BIGINT AS depth FROM scored GROUP BY ROLLUP (lang, source, truth)")
def nested_counts(spark, sf_dir):
    return profiles.nested_counts(views.scored(spark, sf_dir), ["lang", "source", "truth"])


@query(SCORED, 'SELECT lang, count(*) FILTER (WHERE truth = 0) AS "0", count(*) FILTER (WHERE truth = 1) AS "1" FROM scored GROUP BY 1')
def review_contingency(spark, sf_dir):
    return profiles.contingency(views.scored(spark, sf_dir), "lang", "truth", [0, 1])


# Grids

@query(PIXELS, "SELECT (row // 16)::INTEGER AS block_row, (col // 16)::INTEGER AS block_col, min(row) AS first_row, min(col) AS first_col, (max(row) - min(row) + 1)::INTEGER AS height, (max(col) - min(col) + 1)::INTEGER AS width, count(*) AS n FROM px GROUP BY 1, 2")
def blocks(spark, sf_dir):
    return raster.blocks(views.pixels(spark, sf_dir), 16)


@query(PIXELS, "SELECT code, count(*) AS pixels, count(*) * 0.01::DOUBLE AS hectares FROM px GROUP BY 1")
def areas(spark, sf_dir):
    return raster.areas(views.pixels(spark, sf_dir), "code")


@query(PIXELS, "c AS (SELECT (row // 4)::INTEGER AS r, (col // 4)::INTEGER AS c, code, count(*) AS n FROM px WHERE code IS NOT NULL GROUP BY ALL)",
       'SELECT r AS "row", c AS col, code, n_valid FROM (SELECT *, sum(n) OVER (PARTITION BY r, c)::BIGINT AS n_valid, row_number() OVER (PARTITION BY r, c ORDER BY n DESC, code) AS k FROM c) WHERE k = 1')
def overview_mode(spark, sf_dir):
    return raster.overview_mode(views.pixels(spark, sf_dir), "code", 4)


@query(PIXELS, 'SELECT (row // 4)::INTEGER AS "row", (col // 4)::INTEGER AS col, round(avg(value), 6) + 0.0 AS mean, count(value) AS n_valid FROM px GROUP BY 1, 2')
def overview_mean(spark, sf_dir):
    return six(raster.overview_mean(views.pixels(spark, sf_dir), "value", 4), "mean")


@query(PIXELS, 'SELECT DISTINCT row + i AS "row", col + j AS col FROM px, (VALUES (-1), (0), (1)) a(i), (VALUES (-1), (0), (1)) b(j) WHERE water')
def dilate(spark, sf_dir):
    return raster.dilate(views.pixels(spark, sf_dir).where("water"))


@query(PIXELS, "f AS (SELECT row, col FROM px WHERE water), g(row, col, r0, c0) AS (SELECT row, col, row, col FROM f UNION SELECT f.row, f.col, g.r0, g.c0 FROM g JOIN f ON abs(f.row - g.row) <= 1 AND abs(f.col - g.col) <= 1)",
       'm AS (SELECT row, col, min(r0 * 2147483648 + c0)::BIGINT AS patch FROM g GROUP BY ALL)', 'SELECT row AS "row", col, patch, count(*) OVER (PARTITION BY patch) AS size FROM m QUALIFY count(*) OVER (PARTITION BY patch) >= 3')
def water_patches(spark, sf_dir):
    return raster.patches(views.pixels(spark, sf_dir).where("water"), 3)


@query(PIXELS, 'SELECT a.row AS "row", a.col, round(min(sqrt((a.row - b.row) ** 2 + (a.col - b.col) ** 2)) * 10, 6) + 0.0 AS d FROM px a LEFT JOIN px b ON b.row % 17 = 3 AND b.col % 19 = 5 AND (a.row - b.row) ** 2 + (a.col - b.col) ** 2 <= 64 GROUP BY 1, 2')
def bounded_distance(spark, sf_dir):
    px = views.pixels(spark, sf_dir)
    return six(raster.bounded_distance(px, px.where("row % 17 = 3 and col % 19 = 5"), 8, 10.0), "d")


@query(PIXELS, """SELECT row AS "row", col, CASE WHEN (value * 200)::FLOAT <= 100 OR ((1 - value::DOUBLE) * 400)::FLOAT <= 120 THEN 'lake' WHEN z % 50 <= 30 THEN 'stream' ELSE 'slope' END AS setting FROM px""")
def proximity_setting(spark, sf_dir):
    px = views.pixels(spark, sf_dir)
    return px.select("row", "col", decisions.proximity_setting(F.col("value") * 200, (1 - F.col("value")) * 400, F.col("z") % 50).alias("setting"))


NEIGHBOURS = """n AS (SELECT a.row, a.col, i, j, (a.z - b.z) / (CASE WHEN i <> 0 AND j <> 0 THEN sqrt(2) ELSE 1 END * 10) AS d FROM px a, (VALUES (-1), (0), (1)) x(i), (VALUES (-1), (0), (1)) y(j), px b
 WHERE (i <> 0 OR j <> 0) AND b.row = a.row + i AND b.col = a.col + j),
r AS (SELECT *, count(*) OVER (PARTITION BY row, col) AS k, row_number() OVER (PARTITION BY row, col ORDER BY round(d, 9) DESC, i, j) AS o FROM n),
t AS (SELECT row, col, CASE WHEN k = 8 AND d > 0 THEN row + i END AS tr, CASE WHEN k = 8 AND d > 0 THEN col + j END AS tc FROM r WHERE o = 1)"""


@query(PIXELS, NEIGHBOURS, 'SELECT row AS "row", col, tr AS to_row, tc AS to_col FROM t')
def d8_receivers(spark, sf_dir):
    return hydrology.receivers(views.pixels(spark, sf_dir), 10.0)


@query(PIXELS, NEIGHBOURS, "f(row, col) AS (SELECT row, col FROM t UNION ALL SELECT tr, tc FROM f JOIN t USING (row, col) WHERE tr IS NOT NULL)", 'SELECT row AS "row", col, round(count(*) * 0.01, 6) + 0.0 AS hectares FROM f GROUP BY 1, 2')
def flow_accumulation(spark, sf_dir):
    return six(hydrology.accumulation(hydrology.receivers(views.pixels(spark, sf_dir), 10.0), 10.0), "hectares")


# Self-training and texts

@query(POINTS, f"l AS (SELECT point_id, {YES_NO} AS label, proba, doubtful FROM points)",
       "SELECT point_id AS id FROM l WHERE (label = 'yes' OR (proba >= 0.7 AND label <> 'no' AND NOT doubtful)) AND label <> 'no'")
def self_training_sets(spark, sf_dir):
    rows = views.points(spark, sf_dir).select(F.col("point_id").alias("id"), labels.yes_no(F.col("raw_label")).alias("label"), "proba", "doubtful")
    base, negatives = rows.where("label = 'yes'").select("id"), rows.where("label = 'no'").select("id")
    return training.next_positives(base, base.limit(0), training.promotable(rows), negatives)


@query("SELECT doc_id, lower(source) || '_' || lower(lang) AS slug FROM documents")
def slug(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", labels.slug(F.concat_ws(" - ", "source", "lang")).alias("slug"))


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' ELSE lang END AS lang FROM documents")
def translate_values(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", labels.translated(F.col("lang"), {"en": "English", "de": "German"}).alias("lang"))


@query("SELECT page_id, md5(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')) AS escaped FROM pages")
def html_escape(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(labels.html_escape(F.col("html"))).alias("escaped"))


# Not for SQL

@query()
def forest_cv_metrics(spark, sf_dir):
    """Metrics of class 0 against the rest by a forest that was cross-validated over groups of rows."""
    rows = views.predictors(spark, sf_dir).withColumns({"code": (F.col("code") == 0).cast("double"), "zone": F.col("vec_id") % 10})
    done = training.cross_validated(rows, "code", PS, "zone", 3, trees=10, depth=5)
    return evaluation.class_metrics(evaluation.confusion(done.withColumn("code", F.col("code").cast("int")), "code", "predicted"), "code", "predicted")


@query()
def inflation_factors(spark, sf_dir):
    values = quality.inflation(views.predictors(spark, sf_dir), PS)
    return spark.createDataFrame([(k, float(v)) for k, v in values.items()], "column string, vif double")


# More of the same families

@query(POINTS, f"s(ax, ay, bx, b_y) AS (VALUES (500.0, 100.0, 15000.0, 900.0), (15000.0, 900.0, 15000.0, 1500.0))", """l AS (SELECT *, (bx - ax) ** 2 + (b_y - ay) ** 2 AS len FROM s),
d AS (SELECT point_id, sqrt((x - ax - t * (bx - ax)) ** 2 + (y - ay - t * (b_y - ay)) ** 2) AS d FROM (SELECT *, least(greatest(((x - ax) * (bx - ax) + (y - ay) * (b_y - ay)) / len, 0), 1) AS t FROM points, l))""",
       "SELECT point_id, round(min(d) FILTER (WHERE d <= 400), 6) + 0.0 AS d FROM d GROUP BY 1")
def stream_distance(spark, sf_dir):
    lines = spark.createDataFrame([(500.0, 100.0, 15000.0, 900.0), (15000.0, 900.0, 15000.0, 1500.0)], "ax double, ay double, bx double, by double")
    p = views.points(spark, sf_dir).select(F.col("point_id").alias("from_id"), "x", "y")
    return six(spatial.nearest_segment(p, lines, 400.0).withColumnRenamed("from_id", "point_id"), "d")


@query(POINTS, "SELECT point_id FROM points WHERE sqrt((x - 7000.0) ** 2 + (y - 300.0) ** 2) <= 500 ORDER BY sqrt((x - 7000.0) ** 2 + (y - 300.0) ** 2), point_id LIMIT 1")
def nearest_click(spark, sf_dir):
    p = views.points(spark, sf_dir).select(F.col("point_id").alias("from_id"), "x", "y")
    return spatial.nearest_to(p, 7000.0, 300.0, 500.0).select(F.col("from_id").alias("point_id"))


@query(POINTS, "SELECT point_id, 'cell_' || round_even(x / 500.0, 0)::BIGINT || '_' || round_even(y / 500.0, 0)::BIGINT AS zone FROM points")
def spatial_zones(spark, sf_dir):
    return views.points(spark, sf_dir).select("point_id", geo.degree_cell(F.col("x"), F.col("y"), 500.0).alias("zone"))


@query(POINTS, PIXELS, 'SELECT p.point_id, code, round(value, 6) + 0.0 AS value FROM points p LEFT JOIN px ON px.row = (p.point_id // 5)::INTEGER AND px.col = (p.point_id % 53)::INTEGER')
def cell_lookup(spark, sf_dir):
    p = views.points(spark, sf_dir).select("point_id", F.floor(F.col("point_id") / 5).cast("int").alias("row"), (F.col("point_id") % 53).cast("int").alias("col"))
    return six(spatial.cell_lookup(p, views.pixels(spark, sf_dir).select("row", "col", "code", "value")).select("point_id", "code", "value"), "value")


@query(POINTS, PIXELS, "SELECT p.point_id, round(avg(value), 6) + 0.0 AS mean, count(value) AS n_valid FROM points p LEFT JOIN px ON px.row BETWEEN p.point_id // 5 - 2 AND p.point_id // 5 + 2 AND abs(px.col - p.point_id % 53) <= 2 GROUP BY 1")
def window_mean(spark, sf_dir):
    p = views.points(spark, sf_dir).select(F.col("point_id").alias("from_id"), F.floor(F.col("point_id") / 5).cast("int").alias("row"), (F.col("point_id") % 53).cast("int").alias("col"))
    return six(spatial.neighbourhood(p, views.pixels(spark, sf_dir), 2, "value").withColumnRenamed("from_id", "point_id"), "mean")


@query(POINTS, PIXELS, "SELECT (p.point_id % 4)::INTEGER AS real, code, count(*) AS n FROM points p LEFT JOIN px ON px.row = p.point_id // 5 AND px.col = p.point_id % 53 GROUP BY ALL")
def sample_against_map(spark, sf_dir):
    p = views.points(spark, sf_dir).select((F.col("point_id") % 4).cast("int").alias("real"), F.floor(F.col("point_id") / 5).cast("int").alias("row"), (F.col("point_id") % 53).cast("int").alias("col"))
    return raster.compared(p, views.pixels(spark, sf_dir), "real", "code")


@query(PIXELS, "SELECT (row // 8)::INTEGER AS block_row, (col // 8)::INTEGER AS block_col, count(*) FILTER (WHERE value < 0.1 OR row < 8) AS n_allowed, count(*) AS n, count(*) FILTER (WHERE value < 0.1 OR row < 8) = count(*) AS whole FROM px GROUP BY 1, 2 HAVING count(*) FILTER (WHERE value < 0.1 OR row < 8) > 0")
def useful_blocks(spark, sf_dir):
    return raster.useful_blocks(views.pixels(spark, sf_dir), (F.col("value") < 0.1) | (F.col("row") < 8), 8)


@query(PIXELS, 's AS (SELECT a::INTEGER AS sx, b::INTEGER AS sy FROM range(20) x(a), range(20) y(b))', "SELECT sx, sy, code FROM s LEFT JOIN px ON px.row = floor(sy * 2.7) AND px.col = floor(sx * 2.7)")
def viewport(spark, sf_dir):
    screen = raster.grid_pixels(spark, 20, 20).select(F.col("col").alias("sx"), F.col("row").alias("sy"), (F.col("row") * 2.7).alias("row"), (F.col("col") * 2.7).alias("col"))
    return raster.viewport(screen, views.pixels(spark, sf_dir), "code")


@query(OBSERVATIONS, "y AS (SELECT DISTINCT point_id, year::INTEGER AS year FROM obs), i AS (SELECT point_id, year, year - row_number() OVER (PARTITION BY point_id ORDER BY year) AS g FROM y), r AS (SELECT point_id, min(year) AS a, max(year) AS b FROM i GROUP BY point_id, g)",
       "SELECT point_id, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ', ' ORDER BY a) AS years FROM r GROUP BY 1")
def year_ranges(spark, sf_dir):
    return sequences.year_ranges(views.observations(spark, sf_dir), "point_id", "year")


@query(SCENES, "SELECT point_id, value FROM (SELECT point_id, value, row_number() OVER (PARTITION BY point_id ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY point_id) AS n FROM scenes) WHERE r = n // 2")
def upper_median(spark, sf_dir):
    return sequences.upper_median(views.scenes(spark, sf_dir), ["point_id"], "value")


@query(SCENES, "h AS (SELECT day(ts) AS i, count(DISTINCT point_id) AS n FROM scenes GROUP BY 1), d AS (SELECT i, n, n - coalesce(lag(n) OVER (ORDER BY i), 0) AS n_new FROM h)", "SELECT i, n, n_new, n_new = 0 AS converged FROM d")
def iteration_deltas(spark, sf_dir):
    history = views.scenes(spark, sf_dir).groupBy(F.dayofmonth("ts").cast("long").alias("i")).agg(F.countDistinct("point_id").alias("n"))
    return sequences.deltas(history, "i", "n")


@query("b AS (SELECT p_brand AS brand, p_partkey AS id, p_retailprice AS price, p_size AS size FROM part)", "SELECT brand, id FROM (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY size DESC, price DESC, id) AS r FROM b) WHERE r = 1")
def best_candidate(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("price"), F.col("p_size").alias("size"))
    return sequences.top_by(rows, ["brand"], "id", [F.col("size"), F.col("price")]).select("brand", "id")


@query("SELECT p_partkey, p_type AS kind, CASE WHEN length(p_name) > 3 THEN substr(p_name, (SELECT coalesce(max(i), 0) FROM range(1, 60) r(i), (SELECT min(p_name) AS lo, max(p_name) AS hi FROM part) WHERE i <= length(lo) AND left(lo, i) = left(hi, i)) + 1) ELSE p_name END AS short FROM part")
def shortened_names(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("kind"), "p_name")
    return sequences.shortened(rows, "p_name", 3).select("p_partkey", "kind", "short")


@query("SELECT n_nationkey, n_name, n_regionkey, kind FROM (SELECT *, lag(n_regionkey) OVER (ORDER BY n_regionkey, n_nationkey) IS DISTINCT FROM n_regionkey AS s FROM nation), (VALUES ('title'), ('entry')) k(kind) WHERE s OR kind = 'entry'")
def legend_rows(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").withColumn("place", F.col("n_regionkey") * 1000 + F.col("n_nationkey"))
    return sequences.legend(nations, "place", "n_regionkey").select("n_nationkey", "n_name", "n_regionkey", "kind")


@query(PREDICTORS, "c AS (SELECT quantile_cont(p1, 0.15) AS g, quantile_cont(p2, 0.85) AS r, quantile_cont(p4, 0.85) AS w FROM tab)",
       "SELECT vec_id, CASE WHEN p4 >= w AND p1 <= g THEN 'mixed-water' WHEN p2 >= r AND p1 <= g THEN 'mixed-rock' ELSE 'pure' END AS purity FROM tab, c")
def purity_population(spark, sf_dir):
    return decisions.purity_by_population(views.predictors(spark, sf_dir), "p1", "p2", "p4").select("vec_id", "purity")


@query(PREDICTORS, "m AS (SELECT CASE WHEN count(p1) FILTER (code = 1) >= 5 THEN median(p1) FILTER (code = 1) ELSE 0.6 END AS cut FROM tab)",
       "SELECT vec_id, CASE WHEN p1 >= cut THEN 'pure' WHEN p2 > 0.5 THEN 'mixed-water' WHEN p1 IS NOT NULL THEN 'mixed-rock' END AS purity FROM tab, m")
def purity_by_cut(spark, sf_dir):
    t = views.predictors(spark, sf_dir)
    cut = decisions.median_or(t.where("code = 1"), "p1")
    return t.crossJoin(F.broadcast(cut)).select("vec_id", decisions.purity(F.col("p1"), F.col("cut"), F.col("p2") > 0.5).alias("purity"))  # one row


TYPES = """t AS (SELECT p1, p2, p4, p5, p6, vec_id, CASE WHEN abs(p1) * 400 < 120 THEN 'lake' WHEN p2 > 0.05 AND abs(p4) < 0.12 THEN 'lake' WHEN abs(p5) * 200 < 30 THEN 'stream' WHEN p6 * 40 > 6.5 THEN 'stream' WHEN abs(p4) * 50 < 7 THEN 'stream' ELSE 'slope' END AS setting,
 CASE WHEN p2 > 0.10 THEN 'wet' ELSE 'dry' END AS wetness FROM tab), w AS (SELECT *, CASE vec_id % 6 WHEN 0 THEN 'lake' WHEN 1 THEN 'river' WHEN 2 THEN 'slope' END AS reviewed FROM t)"""


def _typed(spark, sf_dir):
    t = views.predictors(spark, sf_dir)
    p = {c: F.col(c) for c in PS}
    setting = decisions.setting(F.abs(p["p1"]) * 400, p["p2"], F.abs(p["p4"]), F.abs(p["p5"]) * 200, p["p6"] * 40, F.abs(p["p4"]) * 50)
    k = F.col("vec_id") % 6
    reviewed = F.when(k == 0, F.lit("lake")).when(k == 1, F.lit("river")).when(k == 2, F.lit("slope"))
    rows = t.select("vec_id", setting.alias("setting"), decisions.wetness(p["p2"], p["p6"]).alias("wetness"), reviewed.alias("setting_reviewed"))
    return decisions.with_review(rows, {"setting": ("lake", "stream", "slope")})


@query(PREDICTORS, TYPES, "SELECT vec_id, CASE WHEN reviewed IN ('lake', 'slope') THEN reviewed ELSE setting END AS setting, setting AS setting_rule, coalesce(reviewed = 'river', false) AS setting_invalid, wetness FROM w")
def typology(spark, sf_dir):
    return _typed(spark, sf_dir).select("vec_id", "setting", "setting_rule", F.coalesce("setting_invalid", F.lit(False)).alias("setting_invalid"), "wetness")


@query(PREDICTORS, TYPES, "SELECT 'setting' AS level, count(reviewed) AS reviewed, count(*) FILTER (WHERE reviewed <> setting) AS corrected FROM w")
def review_summary(spark, sf_dir):
    return decisions.review_summary(_typed(spark, sf_dir), ["setting"])


@query(PIXELS, "SELECT row AS \"row\", col, CASE WHEN water AND code <> 0 THEN 0 ELSE code END AS code, round(CASE WHEN water AND code <> 0 THEN 1 - value ELSE value END, 6) + 0.0 AS best FROM px")
def lake_override(spark, sf_dir):
    px = views.pixels(spark, sf_dir)
    code, best = decisions.water_override(F.col("code"), F.col("value"), 1 - F.col("value"), F.col("water"))
    return six(px.select("row", "col", code.alias("code"), best.alias("best")), "best")


@query(POINTS, "SELECT point_id FROM points WHERE point_id % 3 <> 0")
def missing_reads(spark, sf_dir):
    from terrafold.sources.points import read_missing

    p = views.points(spark, sf_dir).select("point_id")
    return read_missing(p, p.where("point_id % 3 = 0"), ["point_id"])


@query(PIXELS, "pit AS (SELECT row, col, CASE WHEN row % 12 = 5 AND col % 10 = 4 THEN z - 40 ELSE z END AS z FROM px)",
       "n AS (SELECT a.row, a.col, count(*) AS n, min(b.z) AS low FROM pit a, (VALUES (-1), (0), (1)) x(i), (VALUES (-1), (0), (1)) y(j), pit b WHERE (i <> 0 OR j <> 0) AND b.row = a.row + i AND b.col = a.col + j GROUP BY 1, 2)",
       'SELECT p.row AS "row", p.col, round(CASE WHEN n.n = 8 THEN greatest(z, low) ELSE z END, 6) + 0.0 AS z FROM pit p LEFT JOIN n ON n.row = p.row AND n.col = p.col')
def filled_surface(spark, sf_dir):
    """Depressions of the grid filled until every cell drains to the edge. The valley drains but for single pits, which
    rise to their lowest neighbour: that is what the SQL says."""
    px = views.pixels(spark, sf_dir).withColumn("z", F.when((F.col("row") % 12 == 5) & (F.col("col") % 10 == 4), F.col("z") - 40).otherwise(F.col("z")))
    return six(hydrology.filled(px), "z")


@query()
def spaced_points(spark, sf_dir):
    """A maximal subset of the points that keep a distance."""
    rows = views.points(spark, sf_dir).select(F.col("point_id").alias("id"), "x", "y")
    return six(spatial.spaced(rows, 400.0), "x", "y")


from terrafold.plans import maps, reviews, studies  # noqa: E402, F401  they register their queries
