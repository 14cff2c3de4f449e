"""Routes over a classified grid: equal pieces, point to cell, stretches."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import SECTORS, aspect_sector, class_name
from ..model import DISCLAIMER, GridMeta


def segmentize(vertices: DataFrame, step: float) -> DataFrame:
    """(route_id, part, seq, x, y) -> pieces (.., piece, x, y, length): each segment in ceil(length / step) equal ones."""
    if not math.isfinite(step) or step <= 0:
        raise ValueError("step must be finite and above zero")
    w = Window.partitionBy("route_id", "part").orderBy("seq")
    seg = vertices.withColumns({"_x2": F.lead("x").over(w), "_y2": F.lead("y").over(w)})
    seg = seg.withColumn("_len", F.sqrt((F.col("_x2") - F.col("x")) * (F.col("_x2") - F.col("x")) + (F.col("_y2") - F.col("y")) * (F.col("_y2") - F.col("y"))))
    seg = seg.where((F.col("_len") > 0) & ~F.isnan("_len") & (F.col("_len") < float("inf"))).withColumn("_n", F.greatest(F.lit(1), F.ceil(F.col("_len") / step)).cast("int"))
    p = seg.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    t = (F.col("piece") + 0.5) / F.col("_n")
    return p.select(
        "route_id", "part", "seq", "piece", (F.col("x") + t * (F.col("_x2") - F.col("x"))).alias("x"), (F.col("y") + t * (F.col("_y2") - F.col("y"))).alias("y"), (F.col("_len") / F.col("_n")).alias("length")
    )


def cell_of(x: Column, y: Column, meta: GridMeta) -> tuple[Column, Column]:
    """(row, col), nulls outside; the right and bottom edges are outside."""
    row, col = F.floor((F.lit(meta.y0) - y) / meta.dy), F.floor((x - meta.x0) / meta.dx)
    ok = row.between(0, meta.rows - 1) & col.between(0, meta.cols - 1)
    return F.when(ok, row).cast("int"), F.when(ok, col).cast("int")


def sample(points: DataFrame, cells: DataFrame, meta: GridMeta) -> DataFrame:
    """Points with the layers of their cell (left equi-join) and `outside`."""
    row, col = cell_of(F.col("x"), F.col("y"), meta)
    layers = [c for c in cells.columns if c not in ("grid_id", "row", "col")]
    p = points.withColumns({"row": row, "col": col})
    return p.join(cells.select("row", "col", *layers), ["row", "col"], "left").withColumn("outside", F.col("row").isNull()).drop("row", "col")


def stretches(pieces: DataFrame) -> DataFrame:
    """Runs of equal part, class and outside flag, with lengths, elevation range, aspect lengths and flags.

    pieces: segmentize() and sample() with columns exposure, and dem, aspect, travel_angle, overhead, pra if known.
    Start and end are cumulative over the parts of a route.
    """
    for name in ("dem", "aspect", "travel_angle", "overhead", "pra"):
        if name not in pieces.columns:
            pieces = pieces.withColumn(name, F.lit(None).cast("double"))
    w = Window.partitionBy("route_id").orderBy("part", "seq", "piece")
    p = pieces.withColumn("class", F.when(F.col("exposure").between(0, 4), F.col("exposure").cast("int")))
    key = F.struct("part", F.coalesce("class", F.lit(-1)), "outside")
    p = p.withColumn("_new", F.when(F.lag(key).over(w) == key, 0).otherwise(1)).withColumns({
        "stretch": F.sum("_new").over(w), "_end": F.sum("length").over(w),
    })
    sector = aspect_sector(F.col("aspect"))
    by_aspect = [F.sum(F.when(sector == s, F.col("length")).otherwise(0.0)).alias(f"_{s}") for s in SECTORS]
    over = F.when(F.col("overhead").between(0, 100), F.col("overhead"))
    out = p.groupBy("route_id", "stretch").agg(
        F.first("part").alias("part"), F.first("class").alias("class"), F.first("outside").alias("outside"), F.sum("length").alias("length"),
        F.min(F.col("_end") - F.col("length")).alias("start"), F.max("_end").alias("end"), F.min("dem").alias("min_elevation"), F.max("dem").alias("max_elevation"),
        F.sum(F.when(F.col("pra") == 1, F.col("length")).otherwise(0.0)).alias("release_m"), F.sum(F.when(F.col("travel_angle") > 0, F.col("length")).otherwise(0.0)).alias("path_m"),
        F.max(over).alias("max_overhead"), *by_aspect,
    )
    lengths = F.array(*[F.col(f"_{s}") for s in SECTORS])
    best = F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0), lambda b, i: F.when(F.get(lengths, i) >= F.get(lengths, b), i).otherwise(b))
    dominant = F.when(F.array_max(lengths) > 0, F.get(F.array(*map(F.lit, SECTORS)), best))
    aspect_m = F.map_from_arrays(F.array(*map(F.lit, SECTORS)), lengths)
    return out.withColumns({"dominant_aspect": dominant, "aspect_m": aspect_m}).drop(*[f"_{s}" for s in SECTORS])


def totals(s: DataFrame) -> DataFrame:
    """One row per route: metres by class, without data, outside, in release areas, on paths; the highest class."""
    known, out = F.col("class").isNotNull(), F.col("outside")
    return s.groupBy("route_id").agg(
        F.sum("length").alias("total_m"), *[F.sum(F.when(F.col("class") == k, F.col("length")).otherwise(0.0)).alias(f"class{k}_m") for k in range(5)],
        F.sum(F.when(~known & ~out, F.col("length")).otherwise(0.0)).alias("nodata_m"), F.sum(F.when(out, F.col("length")).otherwise(0.0)).alias("outside_m"),
        F.sum("release_m").alias("release_m"), F.sum("path_m").alias("path_m"), F.max("class").alias("max_class"),
    )


def evaluate(vertices: DataFrame, cells: DataFrame, meta: GridMeta, step: float | None = None) -> DataFrame:
    """Stretches of routes; a step is half a cell unless given."""
    return stretches(sample(segmentize(vertices, step or min(meta.dx, meta.dy) / 2), cells, meta))


def geojson(s: DataFrame, points: DataFrame) -> DataFrame:
    """(route_id, json): a FeatureCollection, one LineString per stretch. points (route_id, stretch, k, lon, lat)."""
    line = points.groupBy("route_id", "stretch").agg(F.sort_array(F.collect_list(F.struct("k", F.array(F.round("lon", 6), F.round("lat", 6)).alias("p")))).alias("l"))
    f = s.join(line, ["route_id", "stretch"]).select(
        "route_id", "stretch",
        F.struct(
            F.lit("Feature").alias("type"), F.struct(F.lit("LineString").alias("type"), F.transform("l", lambda q: q["p"]).alias("coordinates")).alias("geometry"),
            F.struct(F.col("class"), class_name(F.col("class")).alias("class_name"), F.round("length", 1).alias("length_m"), F.col("outside"), F.col("dominant_aspect")).alias("properties"),
        ).alias("f"),
    )
    all_ = f.groupBy("route_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("stretch", "f"))), lambda q: q["f"]).alias("features"))
    return all_.select("route_id", F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features", F.lit(DISCLAIMER).alias("disclaimer")), {"ignoreNullFields": "false"}).alias("json"))
