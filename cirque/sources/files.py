"""Route, area and forecast files as DataFrames: GPX, GeoJSON, product and zone JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

POINTS = "array<array<double>>"


def _attribute(tag: Column, name: str) -> Column:
    return F.regexp_extract(tag, rf"""\s{name}\s*=\s*["']([^"']*)["']""", 1)


def gpx(texts: DataFrame, text: str = "value") -> DataFrame:
    """(route_id, .. text) -> (route_id, part, seq, lon, lat). Track segments and routes are parts; waypoints
    are ignored; prefixes are stripped; a point without a numeric lat or lon, or an open tag, is an error."""
    clean = F.regexp_replace(F.regexp_replace(F.col(text), r"(?s)<!--.*?-->", ""), r"<(/?)[A-Za-z_][\w.-]*:", "<$1")
    tags = F.regexp_extract_all(clean, F.lit(r"(?s)<(trkseg|rte|trkpt|rtept)\b([^>]*)(>|$)"), F.lit(0))
    t = texts.select("route_id", F.posexplode(tags).alias("k", "tag"))
    opens = t.withColumn("part_open", F.col("tag").rlike(r"^<(trkseg|rte)[\s/>]").cast("int"))
    w = Window.partitionBy("route_id").orderBy("k")
    p = opens.withColumn("part", F.sum("part_open").over(w) - 1).where("part_open = 0")
    lat, lon = _attribute(F.col("tag"), "lat").try_cast("double"), _attribute(F.col("tag"), "lon").try_cast("double")
    bad = ~F.col("tag").endswith(">") | lat.isNull() | lon.isNull()
    p = p.select(
        "route_id", F.col("part").cast("int").alias("part"), F.col("k"),
        F.when(bad, F.raise_error(F.concat(F.lit("bad point: "), "tag")).cast("double")).otherwise(lon).alias("lon"), lat.alias("lat"),
    )
    return p.withColumn("seq", F.row_number().over(Window.partitionBy("route_id", "part").orderBy("k")) - 1).drop("k").select("route_id", "part", "seq", "lon", "lat")


def _geometries(texts: DataFrame, text: str) -> DataFrame:
    """(route_id, g, kind, coordinates): geometries of Features, collections and bare ones, two levels deep."""
    g = "type string, coordinates string"
    one = f"{g}, geometries array<struct<{g}>>"
    schema = f"{one}, geometry struct<{one}>, features array<struct<type string, geometry struct<{one}>>>"
    j = texts.select("route_id", F.from_json(text, schema, {"mode": "FAILFAST"}).alias("j"))
    flat = lambda x: F.concat(F.array(F.struct(x["type"].alias("type"), x["coordinates"].alias("coordinates"))), F.coalesce(x["geometries"], F.array()))
    features = F.flatten(F.transform(F.coalesce("j.features", F.array()), lambda f: flat(f["geometry"])))
    every = F.concat(flat(F.col("j")), F.when(F.col("j.geometry").isNotNull(), flat(F.col("j.geometry"))).otherwise(F.array()), features)
    return j.select("route_id", F.posexplode(every).alias("g", "x")).select("route_id", "g", F.col("x.type").alias("kind"), F.col("x.coordinates").alias("coordinates"))


def geojson_lines(texts: DataFrame, text: str = "value") -> DataFrame:
    """(route_id, part, seq, lon, lat) of LineString and MultiLineString; other kinds are ignored."""
    g = _geometries(texts, text).where("kind in ('LineString', 'MultiLineString')")
    lines = F.when(F.col("kind") == "LineString", F.array(F.from_json("coordinates", POINTS))).otherwise(F.from_json("coordinates", f"array<{POINTS}>"))
    p = g.select("route_id", "g", F.posexplode(lines).alias("l", "line"))
    p = p.withColumn("part", F.row_number().over(Window.partitionBy("route_id").orderBy("g", "l")) - 1)
    p = p.select("route_id", "part", F.posexplode("line").alias("seq", "c"))
    bad = F.get("c", F.lit(1)).isNull()
    return p.select("route_id", "part", "seq", F.when(bad, F.raise_error(F.lit("bad coordinates")).cast("double")).otherwise(F.get("c", F.lit(0))).alias("lon"), F.get("c", F.lit(1)).alias("lat"))


def geojson_edges(texts: DataFrame, text: str = "value") -> DataFrame:
    """(route_id, poly_id, ring, seq, x1, y1, x2, y2) of Polygon and MultiPolygon rings, closed."""
    g = _geometries(texts, text).where("kind in ('Polygon', 'MultiPolygon')")
    polys = F.when(F.col("kind") == "Polygon", F.array(F.from_json("coordinates", f"array<{POINTS}>"))).otherwise(F.from_json("coordinates", f"array<array<{POINTS}>>"))
    p = g.select("route_id", "g", F.posexplode(polys).alias("p", "rings")).select("route_id", (F.col("g") * 100000 + F.col("p")).cast("long").alias("poly_id"), F.posexplode("rings").alias("ring", "pts"))
    p = p.select("route_id", "poly_id", "ring", "pts", F.posexplode("pts").alias("seq", "a"))
    b = F.get("pts", (F.col("seq") + 1) % F.size("pts"))
    return p.select("route_id", "poly_id", "ring", "seq", F.col("a")[0].alias("x1"), F.col("a")[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2"))


def read_route(spark: SparkSession, path: str) -> DataFrame:
    """A file by its ending; it needs a line of two points."""
    t = spark.read.text(path, wholetext=True).withColumn("route_id", F.lit(0).cast("long"))
    if path.endswith(".gpx"):
        out = gpx(t)
    elif path.endswith((".geojson", ".json")):
        out = geojson_lines(t)
    else:
        raise ValueError("a route is .gpx, .geojson or .json")
    if out.groupBy("route_id", "part").count().where("count >= 2").isEmpty():
        raise ValueError("the file has no line of two points")
    return out


PRODUCT = (
    "array<struct<type string, id string, areaId string, title string, polygons array<string>, issueDateTime string, expiryDateTime string, "
    "dangerRatings struct<days array<struct<date string, btl string, tln string, alp string>>>, "
    "avalancheProblems struct<days array<array<struct<type string, likelihood string, aspectElevations array<string>, expectedSize struct<min string, max string>>>>>>>"
)


def products(texts: DataFrame, text: str = "value") -> DataFrame:
    """(seq, id, area_id, title, polygons, issued, expires, days): forecasts only; as many days as ratings or
    problems have; numbers may be strings; a forecast without id or area is an error."""
    p = texts.select(F.posexplode(F.from_json(text, PRODUCT)).alias("seq", "p")).where("p.type = 'avalancheforecast'")
    z = F.arrays_zip(F.coalesce("p.dangerRatings.days", F.array()).alias("danger"), F.coalesce("p.avalancheProblems.days", F.array()).alias("problems"))
    days = F.transform(z, lambda d: F.struct(d["danger"]["date"].alias("date"), d["danger"]["btl"].alias("btl"), d["danger"]["tln"].alias("tln"), d["danger"]["alp"].alias("alp"), F.coalesce(d["problems"], F.array()).alias("problems")))
    need = lambda c: F.when(F.col(c).isNull(), F.raise_error(F.lit(f"a forecast without {c}")).cast("string")).otherwise(F.col(c))
    return p.select("seq", need("p.id").alias("id"), need("p.areaId").alias("area_id"), F.col("p.title").alias("title"), F.coalesce("p.polygons", F.array()).alias("polygons"), F.col("p.issueDateTime").alias("issued"), F.col("p.expiryDateTime").alias("expires"), days.alias("days"))


def areas(texts: DataFrame, text: str = "value") -> DataFrame:
    """Zone edges (zone_id, area_id, poly_id, ring, x1, y1, x2, y2); an id on the feature or in its properties."""
    schema = "features array<struct<id string, properties struct<id string, areaId string>, geometry struct<type string, coordinates string>>>"
    f = texts.select(F.explode(F.from_json(text, schema)["features"]).alias("f")).select(F.coalesce("f.id", "f.properties.id").alias("zone_id"), F.col("f.properties.areaId").alias("area_id"), F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("c"))
    polys = F.when(F.col("kind") == "Polygon", F.array(F.from_json("c", f"array<{POINTS}>"))).when(F.col("kind") == "MultiPolygon", F.from_json("c", f"array<array<{POINTS}>>")).otherwise(F.raise_error(F.lit("a zone is a Polygon or MultiPolygon")).cast(f"array<array<{POINTS}>>"))
    p = f.select("zone_id", "area_id", F.posexplode(polys).alias("poly_id", "rings")).select("zone_id", "area_id", "poly_id", F.posexplode("rings").alias("ring", "pts"))
    p = p.select("zone_id", "area_id", "poly_id", "ring", "pts", F.posexplode("pts").alias("seq", "a"))
    b = F.get("pts", (F.col("seq") + 1) % F.size("pts"))
    return p.select("zone_id", "area_id", "poly_id", "ring", F.col("a")[0].alias("x1"), F.col("a")[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2"))
