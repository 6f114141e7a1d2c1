"""The driver tables seen as points, observations, scenes, scores and pixels; and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.functions import indices
from terrafold.operators.observations import season
from terrafold.operators.zones import Grid
from terrafold.sources.tables import table

PER_LON, PER_LAT = 88800, 111000
# The label texts that market segments stand for.
SEGMENT_LABELS = {"AUTOMOBILE": "Sí", "BUILDING": "no", "FURNITURE": "", "HOUSEHOLD": "1", "MACHINERY": "quizás"}


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    raw = F.lit(None).cast("string")
    for segment, label in SEGMENT_LABELS.items():
        raw = F.when(F.col("c_mktsegment") == segment, F.lit(label)).otherwise(raw)
    return c.select(
        k.alias("point_id"), ((k % 250) * PER_LON / 1000).alias("x"), (F.floor(k / 250) % 200 * PER_LAT / 1000).alias("y"),
        ((F.col("c_acctbal") + 1000) / 11000).alias("proba"), raw.alias("raw_label"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("basin"), (k % 17 == 0).alias("doubtful"))


POINTS = f"""points AS (SELECT c_custkey AS point_id, (c_custkey % 250) * {PER_LON} / 1000.0 AS x, (c_custkey // 250) % 200 * {PER_LAT} / 1000.0 AS y,
  (c_acctbal + 1000) / 11000 AS proba, CASE c_mktsegment {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in SEGMENT_LABELS.items())} END AS raw_label,
  c_mktsegment AS segment, c_nationkey AS basin, c_custkey % 17 = 0 AS doubtful FROM customer)"""


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        k.alias("ord"), (((k * 7) % 250) * PER_LON / 1000 + (k % 4) * PER_LON / 10000).alias("x"), ((k % 9) * PER_LAT / 1000).alias("y"),
        F.when(F.col("s_nationkey") % 2 == 0, F.lit("yes")).otherwise(F.lit("no")).alias("label"))


TRUTH = f"""truth AS (SELECT s_suppkey AS ord, ((s_suppkey * 7) % 250) * {PER_LON} / 1000.0 + (s_suppkey % 4) * {PER_LON} / 10000.0 AS x,
  (s_suppkey % 9) * {PER_LAT} / 1000.0 AS y, CASE WHEN s_nationkey % 2 = 0 THEN 'yes' ELSE 'no' END AS label FROM supplier)"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unmasked observations within a season, with their indices."""
    line = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'R'")
    ts = F.col("l_shipdate")
    bands = line.select(
        F.col("l_partkey").alias("point_id"), ts.alias("ts"), F.year(ts).alias("year"), season(ts).alias("season"), F.col("l_linestatus").alias("status"), F.col("l_orderkey").alias("scene_id"), F.col("l_linenumber").alias("line"),
        F.col("l_quantity").alias("b8"), (F.col("l_discount") * 500).alias("b4"), (F.col("l_tax") * 500).alias("b3"), (F.col("l_extendedprice") / 2000).alias("b11")).where("season is not null")
    b8, b4, b3, b11 = (F.col(c) for c in ("b8", "b4", "b3", "b11"))
    return bands.withColumns({"ndvi": indices.ndvi(b8, b4), "ndwi": indices.ndwi(b3, b8), "ndmi": indices.ndmi(b8, b11), "ndsi": indices.ndsi(b3, b11)})


OBSERVATIONS = """bands AS (SELECT l_partkey AS point_id, l_shipdate AS ts, year(l_shipdate) AS year, l_linestatus AS status, l_orderkey AS scene_id, l_linenumber AS line,
  CASE WHEN strftime(l_shipdate, '%m-%d') BETWEEN '06-15' AND '07-25' THEN 'early' WHEN strftime(l_shipdate, '%m-%d') BETWEEN '08-01' AND '09-30' THEN 'late' END AS season,
  l_quantity AS b8, l_discount * 500 AS b4, l_tax * 500 AS b3, l_extendedprice / 2000 AS b11 FROM lineitem WHERE l_returnflag <> 'R'),
obs AS (SELECT *, (b8 - b4) / (b8 + b4 + 1e-6) AS ndvi, (b3 - b8) / (b3 + b8 + 1e-6) AS ndwi, (b8 - b11) / (b8 + b11 + 1e-6) AS ndmi, (b3 - b11) / (b3 + b11 + 1e-6) AS ndsi
  FROM bands WHERE season IS NOT NULL)"""


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("scene_id"), "ts", F.col("user_id").alias("point_id"), F.col("event_type").alias("cls"), F.get_json_object("props", "$.k").cast("int").alias("cloud"), "value")


SCENES = "scenes AS (SELECT event_id AS scene_id, ts, user_id AS point_id, event_type AS cls, CAST(json_extract_string(props, '$.k') AS INTEGER) AS cloud, value FROM events)"

N_PREDICTORS = 6


def predictors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, code and p1..p6 of embeddings; p3 is missing in every seventh row."""
    cols = [F.col("embedding")[i].cast("double").alias(f"p{i + 1}") for i in range(N_PREDICTORS)]
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("code"), *cols)
    return rows.withColumn("p3", F.when(F.col("vec_id") % 7 != 0, F.col("p3")))


PREDICTORS = "tab AS (SELECT vec_id, label AS code, " + ", ".join(
    (f"CASE WHEN vec_id % 7 <> 0 THEN embedding[{i}]::DOUBLE END" if i == 3 else f"embedding[{i}]::DOUBLE") + f" AS p{i}" for i in range(1, N_PREDICTORS + 1)) + " FROM embeddings)"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("truth"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    score = ((F.col("doc_id") * 7919) % 1000) / 1000
    return docs.join(marks, "doc_id").select("doc_id", "lang", "source", "truth", score.alias("score"), F.when(score >= 0.4, F.lit(1)).otherwise(F.lit(0)).alias("predicted"))


SCORED = """scored AS (SELECT d.doc_id, lang, source, quality AS truth, ((d.doc_id * 7919) % 1000) / 1000.0 AS score,
  CASE WHEN ((d.doc_id * 7919) % 1000) / 1000.0 >= 0.4 THEN 1 ELSE 0 END AS predicted FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

WIDTH = 48


#: The grid of the pixels: its north-western corner is the origin.
GRID = Grid(0.0, 0.0, 10.0)

#: Rings of the zone to be mapped, in shares of the grid's width and height, southwards: an area, a hole in it, and an outlier.
ZONE = [[(0.02, 0.0105), (0.5, 0.0022), (0.981, 0.052), (0.917, 0.979), (0.53, 0.807), (0.061, 0.991)], [(0.4, 0.402), (0.61, 0.423), (0.553, 0.507)], [(0.9, 0.985), (0.97, 0.987), (0.93, 0.997)]]


def zone_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The zone as rings of polygons, as high as the grid is."""
    height = table(spark, sf_dir, "orders").agg((F.floor(F.max("o_orderkey") / WIDTH) + 1).cast("double").alias("h"))
    points_ = [(0 if k < 2 else 1, k, i, u, v) for k, ring in enumerate(ZONE) for i, (u, v) in enumerate(ring)]
    units = spark.createDataFrame(points_, "polygon int, ring int, at int, u double, v double")
    return units.crossJoin(F.broadcast(height)).select("polygon", "ring", "at", (F.col("u") * (WIDTH * 10.0)).alias("x"), (-(F.col("v") * 10.0 * F.col("h"))).alias("y"))


ZONE_RINGS = "zone_rings AS (SELECT polygon, ring, pos, u * 480.0::DOUBLE AS x, -(v * 10.0::DOUBLE * h) AS y FROM (VALUES " + ", ".join(
    f"({0 if k < 2 else 1}, {k}, {i}, {u}::DOUBLE, {v}::DOUBLE)" for k, ring in enumerate(ZONE) for i, (u, v) in enumerate(ring)) + f") z(polygon, ring, pos, u, v), (SELECT (max(o_orderkey) // {WIDTH} + 1)::DOUBLE AS h FROM orders))"


def ring_sql(name: str, rings: str) -> str:
    """Edges of rings, as a view of that name."""
    return f"""{name} AS (SELECT polygon, x AS ax, y AS ay, coalesce(lead(x) OVER w, first_value(x) OVER w) AS bx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS b_y FROM {rings} WINDOW w AS (PARTITION BY polygon, ring ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""


def inside_sql(name: str, edges: str, pixels: str = "px") -> str:
    """Whether the centre of each pixel lies in any polygon of the edges."""
    return f"""{name} AS (SELECT p.row, p.col, coalesce(bool_or(odd), false) AS inside FROM {pixels} p LEFT JOIN (SELECT row, col, polygon, count(*) % 2 = 1 AS odd FROM (SELECT row, col, (col + 0.5) * 10.0::DOUBLE AS x, 0.0::DOUBLE - (row + 0.5) * 10.0::DOUBLE AS y FROM {pixels}) q JOIN {edges} e
  ON (ay > y) <> (b_y > y) AND ax + (y - ay) * (bx - ax) / (b_y - ay) > x GROUP BY ALL) t ON t.row = p.row AND t.col = p.col GROUP BY ALL)"""


def parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings of a six-sided parcel with a triangular hole for each supplier, over the grid of the pixels."""
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").select(k.alias("polygon"), ((k * 37) % 470 + 3.3).alias("cx"), (-((k * 91) % 2900) - 7.7).alias("cy"), (20 + k % 7 * 9.1).alias("r"))
    corners = F.array(*[F.struct(F.lit(ring).alias("ring"), F.lit(at).alias("at"), F.lit(float(dx)).alias("dx"), F.lit(float(dy)).alias("dy")) for ring, at, dx, dy in CORNERS])
    return s.select("polygon", "cx", "cy", "r", F.inline(corners)).select("polygon", "ring", "at", (F.col("cx") + F.col("r") * F.col("dx")).alias("x"), (F.col("cy") + F.col("r") * F.col("dy")).alias("y"))


CORNERS = [(0, 0, 1, 0), (0, 1, 0.5, 0.875), (0, 2, -0.5, 0.875), (0, 3, -1, 0), (0, 4, -0.5, -0.875), (0, 5, 0.5, -0.875), (1, 0, 0.25, 0.25), (1, 1, -0.375, 0.125), (1, 2, 0.125, -0.5)]
PARCELS = """parcels AS (SELECT polygon, ring, pos, cx + r * dx AS x, cy + r * dy AS y FROM (SELECT s_suppkey AS polygon, ((s_suppkey * 37) % 470 + 3.3::DOUBLE) AS cx, (-((s_suppkey * 91) % 2900) - 7.7::DOUBLE) AS cy, (20 + s_suppkey % 7 * 9.1::DOUBLE) AS r FROM supplier),
 (VALUES """ + ", ".join(f"({ring}, {at}, {dx}::DOUBLE, {dy}::DOUBLE)" for ring, at, dx, dy in CORNERS) + ") c(ring, pos, dx, dy))"


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pixel for each order, in rows of ``WIDTH``: the grid grows with the tables. Elevations form a valley."""
    k, cust = F.col("o_orderkey"), F.col("o_custkey")
    grid = table(spark, sf_dir, "orders").select(F.floor(k / WIDTH).cast("int").alias("row"), (k % WIDTH).cast("int").alias("col"), cust.alias("cust"))
    r, c, cust = F.col("row"), F.col("col"), F.col("cust")
    return grid.select("row", "col", (3000.0 - 2 * r + 3 * F.abs(c - 24)).alias("z"), (cust % 4 == 0).alias("water"),
                       F.when((r + c) % 11 != 0, (F.floor(r / 5) + F.floor(c / 7)) % 4).cast("int").alias("code"), ((cust * 31 + c * 17) % 100 / 100).alias("value"))


PIXELS = f"""px AS (SELECT row, col, 3000.0 - 2 * row + 3 * abs(col - 24) AS z, cust % 4 = 0 AS water,
  CASE WHEN (row + col) % 11 <> 0 THEN ((row // 5 + col // 7) % 4)::INTEGER END AS code, (cust * 31 + col * 17) % 100 / 100.0 AS value
  FROM (SELECT (o_orderkey // {WIDTH})::INTEGER AS row, (o_orderkey % {WIDTH})::INTEGER AS col, o_custkey AS cust FROM orders))"""
