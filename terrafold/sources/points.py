"""Point and line files as DataFrames: KML, GeoJSON and CSV; and the sinks that write them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.functions.geo import from_utm, to_utm

ID_CHAIN = ("ID", "id", "@id", "name")


def _first_id(attrs: Column, fallback: Column) -> Column:
    return F.coalesce(*[F.nullif(F.trim(F.try_element_at(attrs, F.lit(k))), F.lit("")) for k in ID_CHAIN], fallback)


def read_kml(spark: SparkSession, path: str) -> DataFrame:
    """``id, lon, lat, attrs`` of the points of a KML file: the first coordinate of each placemark."""
    schema = "name string, ExtendedData struct<SchemaData:struct<SimpleData:array<struct<_name:string,_VALUE:string>>>>, Point struct<coordinates:string>"
    rows = spark.read.format("xml").option("rowTag", "Placemark").schema(schema).load(path)
    data = F.coalesce(F.col("ExtendedData.SchemaData.SimpleData"), F.array().cast("array<struct<_name:string,_VALUE:string>>"))
    attrs = F.map_from_entries(F.filter(F.transform(data, lambda d: F.struct(d["_name"], d["_VALUE"])), lambda e: e["_name"].isNotNull()))
    attrs = F.when(F.col("name").isNull(), attrs).otherwise(F.map_concat(F.map_filter(attrs, lambda k, v: k != "name"), F.create_map(F.lit("name"), F.col("name"))))
    xy = F.split(F.element_at(F.split(F.trim("Point.coordinates"), r"\s+"), 1), ",")
    out = rows.select(attrs.alias("attrs"), F.get(xy, 0).try_cast("double").alias("lon"), F.get(xy, 1).try_cast("double").alias("lat"))
    return out.where("lon is not null and lat is not null").select(_first_id(F.col("attrs"), F.concat(F.lit("pt_"), F.monotonically_increasing_id())).alias("id"), "lon", "lat", "attrs")


#: The old member that names the projection of a file.
CRS = "crs struct<properties:struct<name:string>>"


def _epsg(crs: Column) -> Column:
    """Code of a projection by its name; null where the file names none."""
    return F.nullif(F.regexp_extract(F.coalesce(crs["properties"]["name"], F.lit("")), r"EPSG:+(\d+)", 1), F.lit("")).cast("int")


def degrees_of(x: Column, y: Column, epsg: Column) -> tuple[Column, Column]:
    """Longitude and latitude of coordinates in a projection: degrees (4326, 4258 or none), or UTM on WGS 84 or ETRS 89; others are an error."""
    utm = epsg.between(32601, 32660) | epsg.between(32701, 32760) | epsg.between(25828, 25838)
    lon, lat = from_utm(x, y, F.coalesce(epsg % 100, F.lit(1)), epsg.between(32701, 32760))
    plain = epsg.isNull() | epsg.isin(4326, 4258)
    other = F.raise_error(F.concat(F.lit("a projection that is not known: EPSG:"), epsg.cast("string"))).cast("double")
    return F.when(plain, x).when(utm, lon).otherwise(other), F.when(plain, y).when(utm, lat).otherwise(other)


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """``id, lon, lat, attrs`` of the points of a GeoJSON collection or feature; of a MultiPoint the first, others are skipped.

    A file that names a UTM projection in the old ``crs`` member is read in degrees too.
    """
    feature = "struct<type:string,id:string,geometry:struct<type:string,coordinates:string>,properties:map<string,string>>"
    schema = f"type string, id string, geometry struct<type:string,coordinates:string>, properties map<string,string>, features array<{feature}>, {CRS}"
    rows = spark.read.option("multiLine", True).schema(schema).json(path)
    one = F.array(F.struct("type", "id", "geometry", "properties"))
    each = rows.select(_epsg(F.col("crs")).alias("epsg"), F.inline(F.when(F.col("features").isNotNull(), F.col("features")).otherwise(one.cast(f"array<{feature}>"))))
    text = F.when(F.col("geometry.type") == "Point", F.col("geometry.coordinates")).when(
        F.col("geometry.type") == "MultiPoint", F.regexp_extract(F.col("geometry.coordinates"), r"\[\s*(\[[^\]]*\])", 1))
    xy = F.from_json(text, "array<double>")
    attrs = F.coalesce(F.col("properties"), F.create_map().cast("map<string,string>"))
    found = each.select(attrs.alias("attrs"), F.col("id").alias("fid"), "epsg", F.get(xy, 0).alias("x"), F.get(xy, 1).alias("y")).where("x is not null and y is not null")
    lon, lat = degrees_of(F.col("x"), F.col("y"), F.col("epsg"))
    out = found.select("attrs", "fid", lon.alias("lon"), lat.alias("lat"))
    return out.where("lon is not null and lat is not null").select(_first_id(F.col("attrs"), F.coalesce("fid", F.concat(F.lit("pt_"), F.monotonically_increasing_id()))).alias("id"), "lon", "lat", "attrs")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``feature, part, ax, ay, bx, by``: the segments of lines and polygons of a GeoJSON file; points are ignored."""
    schema = "features array<struct<geometry:struct<type:string,coordinates:string>>>"
    rows = spark.read.option("multiLine", True).schema(schema).json(path).select(F.posexplode("features").alias("feature", "f"))
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    line, rings, many = "array<array<double>>", "array<array<array<double>>>", "array<array<array<array<double>>>>"
    parts = (F.when(kind == "LineString", F.array(F.from_json(text, line))).when(kind.isin("MultiLineString", "Polygon"), F.from_json(text, rings))
             .when(kind == "MultiPolygon", F.flatten(F.from_json(text, many))))
    each = rows.select("feature", F.posexplode(parts).alias("part", "p")).select("feature", "part", "p", F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("i"))
    point = lambda k, c: F.get(F.get(F.col("p"), F.col("i") + k), c)
    return each.where(F.size("p") > 1).select("feature", "part", point(-1, 0).alias("ax"), point(-1, 1).alias("ay"), point(0, 0).alias("bx"), point(0, 1).alias("by"))


def read_polygons(spark: SparkSession, path: str) -> DataFrame:
    """``polygon, ring, at, lon, lat``: the rings of the polygons of a GeoJSON collection, feature or file of several, holes included.

    Every part of a MultiPolygon is a polygon of its own; rings may repeat their first point at the end. ValueError where there is no polygon.
    """
    feature = "struct<geometry:struct<type:string,coordinates:string>>"
    rows = spark.read.option("multiLine", True).schema(f"geometry struct<type:string,coordinates:string>, features array<{feature}>, {CRS}").json(path)
    each = rows.select(_epsg(F.col("crs")).alias("epsg"), F.posexplode(F.coalesce("features", F.array(F.struct("geometry")))).alias("feature", "f"))
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    parts = F.when(kind == "Polygon", F.array(F.from_json(text, "array<array<array<double>>>"))).when(kind == "MultiPolygon", F.from_json(text, "array<array<array<array<double>>>>"))
    rings = each.select("epsg", "feature", F.posexplode(parts).alias("part", "p")).select("epsg", (F.col("feature") * (1 << 20) + F.col("part")).cast("long").alias("polygon"), F.posexplode("p").alias("ring", "r"))
    points = rings.select("epsg", "polygon", "ring", F.posexplode("r").alias("at", "xy")).select("epsg", "polygon", "ring", "at", F.get("xy", 0).alias("x"), F.get("xy", 1).alias("y"))
    if points.isEmpty():
        raise ValueError(f"{path}: no polygons")
    lon, lat = degrees_of(F.col("x"), F.col("y"), F.col("epsg"))
    return points.select("polygon", "ring", "at", lon.alias("lon"), lat.alias("lat"))


def projected_rings(rings: DataFrame, zone: int) -> DataFrame:
    """``polygon, ring, at, x, y`` of rings in degrees, in metres of a UTM zone."""
    x, y = to_utm(F.col("lon"), F.col("lat"), F.lit(zone))
    return rings.select("polygon", "ring", "at", x.alias("x"), y.alias("y"))


def read_csv(spark: SparkSession, path: str, numbers: list[str]) -> DataFrame:
    """A headed CSV; the named columns are numbers, null where they don't parse."""
    rows = spark.read.option("header", True).csv(path)
    return rows.withColumns({c: F.col(f"`{c}`").try_cast("double") for c in numbers if c in rows.columns})


def write_csv(parts: list[DataFrame], path: str) -> None:
    """All parts under the union of their columns, those of the first part first."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    out.write.option("header", True).csv(path)


def geojson_features(points: DataFrame, drop: list[str] = []) -> DataFrame:
    """``value``: a GeoJSON feature a row; attributes that start with an underscore or are dropped stay out."""
    hidden = F.map_filter("attrs", lambda k, v: ~k.startswith("_") & ~k.isin("ID", *drop))
    geometry = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    return points.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.map_concat(hidden, F.create_map(F.lit("ID"), F.col("id").cast("string"))).alias("properties"))).alias("value"))


def result_features(points: DataFrame, predictors: list[str]) -> DataFrame:
    """Features of classified points as a next run reads them: without the rows of the layer of truth, without predictors
    and hidden attributes, probabilities at four decimals, and without the label that self-training gave."""
    source, origin = F.try_element_at("attrs", F.lit("source")), F.try_element_at("attrs", F.lit("origin"))
    kept = points.where(~F.coalesce(source == "truth", F.lit(False)))
    short = lambda k, v: F.when(k == "proba", F.coalesce(F.round(v.try_cast("double"), 4).cast("string"), v)).otherwise(v)
    own = F.map_filter("attrs", lambda k, v: ~((k == "label") & F.coalesce(origin == "auto", F.lit(False))))
    return geojson_features(kept.withColumn("attrs", F.transform_values(own, short)), predictors)


def write_geojson_lines(points: DataFrame, path: str, drop: list[str] = []) -> None:
    geojson_features(points, drop).write.text(path)


def write_pixels(pixels: DataFrame, path: str) -> None:
    """Pixels by block, so that a window reads only its blocks."""
    from terrafold.operators.raster import block_of

    pixels.withColumns({"block_row": block_of()[0], "block_col": block_of()[1]}).repartition("block_row", "block_col").write.partitionBy("block_row", "block_col").parquet(path)


def read_missing(wanted: DataFrame, cached: DataFrame, keys: list[str]) -> DataFrame:
    """What a read-through cache still lacks."""
    return wanted.join(cached.select(*keys).distinct(), keys, "left_anti")
