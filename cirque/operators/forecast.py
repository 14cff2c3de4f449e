"""Forecast context: zones, forecasts by zone, avalanche problems listed for a stretch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scalars import bands_between, danger_level, decode_location, epoch


def zone_of(points: DataFrame, edges: DataFrame) -> DataFrame:
    """(point columns, zone_id): zones whose polygons have the point inside the outer ring (ring 0) and in no hole.

    edges (zone_id, poly_id, ring, x1, y1, x2, y2); zones are few and their edges' count is checked: up to
    100,000 they are broadcast, beyond that points and edges meet by bands of y.
    """
    n = edges.count()
    span = edges.agg(F.min(F.least("y1", "y2")).alias("lo"), F.max(F.greatest("y1", "y2")).alias("hi")).first()
    height = max(1e-9, ((span["hi"] or 0) - (span["lo"] or 0)) / 256)
    band = lambda y: F.floor((y - (span["lo"] or 0)) / height)
    e = edges.withColumn("_band", F.explode(F.sequence(band(F.least("y1", "y2")), band(F.greatest("y1", "y2")))))
    p = points.withColumn("_band", band(F.col("y")))
    e = F.broadcast(e) if n <= 100_000 else e
    hit = ((F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y"))) & (F.col("x") < (F.col("x2") - F.col("x1")) * (F.col("y") - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1"))
    rings = p.join(e, "_band").where(hit).groupBy(*points.columns, "zone_id", "poly_id", "ring").agg(F.count("*").alias("n")).where("n % 2 = 1")
    polys = rings.groupBy(*points.columns, "zone_id", "poly_id").agg(F.min("ring").alias("r0"), F.max("ring").alias("r1")).where("r0 = 0 and r1 = 0")
    return polys.select(*points.columns, "zone_id").distinct()


def forecast_of(zones: DataFrame, forecasts: DataFrame) -> DataFrame:
    """zones (zone_id, area_id) -> (zone_id, forecast_id): the first forecast (by `seq`) that lists the zone's id
    in `polygons`, else the first with its area_id."""
    listed = forecasts.select("seq", F.col("id").alias("forecast_id"), F.explode("polygons").alias("zone_id"))
    a = zones.join(listed, "zone_id").select("zone_id", F.lit(0).alias("how"), "seq", "forecast_id")
    b = zones.join(forecasts.select("seq", F.col("id").alias("forecast_id"), "area_id"), "area_id").select("zone_id", F.lit(1).alias("how"), "seq", "forecast_id")
    w = Window.partitionBy("zone_id").orderBy("how", "seq")
    return a.unionByName(b).withColumn("_k", F.row_number().over(w)).where("_k = 1").select("zone_id", "forecast_id")


def with_bands(stretches: DataFrame, btl: float | None, alp: float | None) -> DataFrame:
    """Adds `bands` and `band_reason`: all three without treeline or elevation."""
    every = F.array(F.lit("btl"), F.lit("tln"), F.lit("alp"))
    if btl is None or alp is None:
        return stretches.withColumn("bands", every).withColumn("band_reason", F.lit("no treeline given"))
    known = F.col("min_elevation").isNotNull() & F.col("max_elevation").isNotNull()
    got = bands_between(F.col("min_elevation"), F.col("max_elevation"), F.lit(btl), F.lit(alp))
    return stretches.withColumn("bands", F.when(known, got).otherwise(every)).withColumn("band_reason", F.when(~known, F.lit("no elevation")))


def problems_here(stretches: DataFrame, problems: DataFrame) -> DataFrame:
    """Each stretch with each problem of its forecast: listed_here is true where the (aspect, band) sets meet,
    null where the stretch has no aspect or a code isn't understood, else false.

    stretches (forecast_id, dominant_aspect, bands, ..); problems (forecast_id, type, codes ARRAY<STRING>).
    """
    decoded = problems.withColumn("_at", F.transform("codes", decode_location))
    decoded = decoded.withColumn("undecoded", F.size(F.filter("_at", lambda x: x.isNull()))).withColumn("_at", F.filter("_at", lambda x: x.isNotNull()))
    j = stretches.join(decoded, "forecast_id")
    meets = F.exists("_at", lambda q: (q["aspect"] == F.col("dominant_aspect")) & F.array_contains(F.col("bands"), q["band"]))
    listed = F.when(F.col("dominant_aspect").isNull(), None).when(meets, True).when(F.col("undecoded") > 0, None).otherwise(False)
    return j.withColumn("listed_here", listed.cast("boolean")).drop("_at")


def days(forecasts: DataFrame) -> DataFrame:
    """(id, day, btl, tln, alp levels, highest): the highest rated level over the bands."""
    d = forecasts.select("id", F.posexplode("days").alias("day", "d"))
    levels = {b: danger_level(F.col(f"d.{b}")) for b in ("btl", "tln", "alp")}
    return d.select("id", "day", *[v.alias(k) for k, v in levels.items()], F.array_max(F.array_compact(F.array(*levels.values()))).alias("highest"))


def expired(forecasts: DataFrame, now: int) -> DataFrame:
    """Adds expired: null where the time has no zone or can't be read."""
    return forecasts.withColumn("expired", epoch(F.col("expires")) < now)


def annotate(stretches: DataFrame, zones_by_stretch: DataFrame, forecast_by_zone: DataFrame) -> DataFrame:
    """Stretches with zone_id and forecast_id (null outside all zones)."""
    return stretches.join(zones_by_stretch, ["route_id", "stretch"], "left").join(forecast_by_zone, "zone_id", "left")


def no_zone_m(annotated: DataFrame) -> DataFrame:
    return annotated.agg(F.round(F.sum(F.when(F.col("zone_id").isNull(), F.col("length")).otherwise(0.0)), 1).alias("no_zone_m"))
