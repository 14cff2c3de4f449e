"""Grids: from the driver's tables, Parquet in and out, bilinear windows, builds."""

from __future__ import annotations

import functools
import json
from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scalars import utm_forward, utm_inverse
from ..model import DISCLAIMER, GridMeta

COLS = 50


def derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 50-column grid from `part`: a cone with noise, a forest cover in per cent, bands for the rules."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size")
    row, col = F.expr("cast(p_partkey div 50 as int)"), F.expr("cast(p_partkey % 50 as int)")
    k = F.col("p_partkey")
    return p.select(
        F.lit(0).cast("long").alias("grid_id"), row.alias("row"), col.alias("col"),
        (2000 + 4 * F.abs(row - 20) + 3 * F.abs(col - 25) + F.col("p_size")).cast("double").alias("dem"),
        (k * 37 % 101).cast("int").alias("forest"), (k * 13 % 97 - 3).cast("int").alias("travel_angle"),
        (k * 7 % 61 - 1).cast("int").alias("overhead"), F.when(k % 5 == 0, 1).otherwise(0).alias("pra"), (k * 11 % 300).cast("int").alias("cell_count"),
        (k * 17 % 270).cast("double").alias("z_delta"), (k % 3).cast("int").alias("patch"),
    )


def meta_of(cells: DataFrame) -> GridMeta:
    """Extent by one aggregate; cells of 10 m."""
    r = cells.agg(F.max("row").alias("r"), F.max("col").alias("c")).first()
    return GridMeta(0.0, 10.0 * (r["r"] + 1), 10.0, 10.0, r["r"] + 1, r["c"] + 1, 32613)


def write_grid(cells: DataFrame, path: str, meta: GridMeta, provenance: dict | None = None, tile: int = 256) -> None:
    """Partitioned by tile row and sorted within, so that windows prune files and row groups; the manifest is beside."""
    d = cells.withColumn("tile_row", F.expr(f"row div {tile}").cast("int")).withColumn("tile_col", F.expr(f"col div {tile}").cast("int"))
    d.repartition("tile_row", "tile_col").sortWithinPartitions("row", "col").write.partitionBy("tile_row").mode("overwrite").parquet(f"{path}/cells")
    row = {**meta.__dict__, "provenance": json.dumps(provenance or {}), "disclaimer": DISCLAIMER}
    cells.sparkSession.createDataFrame([(json.dumps(row),)], "value string").write.mode("overwrite").text(f"{path}/manifest")


def read_grid(spark: SparkSession, path: str) -> tuple[DataFrame, GridMeta]:
    row = json.loads(spark.read.text(f"{path}/manifest").first()["value"])
    return spark.read.parquet(f"{path}/cells").drop("tile_row", "tile_col"), GridMeta(**{k: row[k] for k in GridMeta.__dataclass_fields__})


def mosaic(spark: SparkSession, path: str, tiles: list[str]) -> tuple[DataFrame, GridMeta]:
    """Stored grids as one: `{tile}` in path stands for each name. Rows and columns are moved to the common corner.

    Where tiles overlap the last one with data counts, layer by layer; the extents come from the manifests, so only
    cells that lie in several tiles are shuffled. A missing tile is an error that names it, and so is one whose
    cells don't fall on those of the first.
    """
    if not tiles:
        raise ValueError("no tiles given")
    parts = []
    for t in tiles:
        try:
            parts.append(read_grid(spark, path.replace("{tile}", t)))
        except AnalysisException as e:
            raise FileNotFoundError(f"tile {t} is missing: {path.replace('{tile}', t)}") from e
    one = parts[0][1]
    x0, y0 = min(m.x0 for _, m in parts), max(m.y0 for _, m in parts)
    spans = []
    for t, (_, m) in zip(tiles, parts):
        r, c = (y0 - m.y0) / one.dy, (m.x0 - x0) / one.dx
        if (m.dx, m.dy, m.epsg) != (one.dx, one.dy, one.epsg) or max(abs(r - round(r)), abs(c - round(c))) > 1e-6:
            raise ValueError(f"tile {t} isn't on the cells of tile {tiles[0]}")
        spans.append((round(r), round(r) + m.rows, round(c), round(c) + m.cols))
    alone, shared = [], []
    for k, ((d, _), (r0, _, c0, _)) in enumerate(zip(parts, spans)):
        d = d.withColumns({"row": (F.col("row") + r0).cast("int"), "col": (F.col("col") + c0).cast("int"), "_k": F.lit(k)})
        over = F.lit(False)
        for j, (a, b, c, e) in enumerate(spans):
            if j != k:
                over = over | (F.col("row").between(a, b - 1) & F.col("col").between(c, e - 1))
        alone.append(d.where(~over).drop("_k"))
        shared.append(d.where(over))
    layers = [c for c in parts[0][0].columns if c not in ("grid_id", "row", "col")]
    union = lambda xs: functools.reduce(lambda a, b: a.unionByName(b), xs)
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_k"))).alias(c) for c in layers]
    both = union(shared).groupBy("row", "col").agg(F.min("grid_id").alias("grid_id"), *last)
    rows, cols = max(s[1] for s in spans), max(s[3] for s in spans)
    return union([*alone, both]), replace(one, x0=x0, y0=y0, rows=rows, cols=cols)


def read_window(spark: SparkSession, path: str, row0: int, row1: int, col0: int, col1: int, tile: int = 256) -> DataFrame:
    """Rows and columns of a stored grid: tile rows prune partitions, row and col push down to row groups."""
    d = spark.read.parquet(f"{path}/cells")
    return d.where(F.col("tile_row").between(row0 // tile, row1 // tile) & F.col("row").between(row0, row1) & F.col("col").between(col0, col1)).drop("tile_row", "tile_col")


def sample_bands(cells: DataFrame, row: int, col: int) -> DataFrame:
    """(band, value) of one cell, all bands."""
    bands = [c for c in cells.columns if c not in ("grid_id", "row", "col")]
    pairs = ", ".join(f"'{b}', cast(`{b}` as double)" for b in bands)
    return cells.where((F.col("row") == row) & (F.col("col") == col)).select(F.expr(f"stack({len(bands)}, {pairs}) as (band, value)"))


def geographic_window(dem: DataFrame, src: GridMeta, target: GridMeta, lon0: float, value: str = "dem") -> DataFrame:
    """Bilinear resampling of a geographic grid (degrees) onto a UTM grid: target cells are generated, projected
    back, and joined to their four source cells by (row, col). Null where one of the four has no data."""
    spark = dem.sparkSession
    cells = spark.range(target.rows * target.cols).select(F.lit(0).cast("long").alias("grid_id"), F.expr(f"cast(id div {target.cols} as int)").alias("row"), F.expr(f"cast(id % {target.cols} as int)").alias("col"))
    x, y = F.lit(target.x0) + (F.col("col") + 0.5) * target.dx, F.lit(target.y0) - (F.col("row") + 0.5) * target.dy
    lon, lat = utm_inverse(x, y, F.lit(lon0))
    c = cells.withColumn("_c", (lon - src.x0) / src.dx - 0.5).withColumn("_r", (src.y0 - lat) / src.dy - 0.5)
    c = c.withColumns({"_c0": F.floor("_c"), "_r0": F.floor("_r")}).withColumns({"_fc": F.col("_c") - F.col("_c0"), "_fr": F.col("_r") - F.col("_r0")})
    corners = F.array(*[F.struct((F.col("_r0") + i).alias("r"), (F.col("_c0") + j).alias("c"), ((F.col("_fr") if i else 1 - F.col("_fr")) * (F.col("_fc") if j else 1 - F.col("_fc"))).alias("w")) for i in (0, 1) for j in (0, 1)])
    four = c.select("grid_id", "row", "col", F.explode(corners).alias("k")).select("grid_id", "row", "col", F.col("k.r").cast("int").alias("sr"), F.col("k.c").cast("int").alias("sc"), F.col("k.w").alias("w"))
    s = dem.select(F.col("row").alias("sr"), F.col("col").alias("sc"), F.col(value).alias("_z"))
    got = four.join(s, ["sr", "sc"], "left").groupBy("grid_id", "row", "col").agg(F.sum(F.col("w") * F.col("_z")).alias("z"), F.count("_z").alias("n"))
    return got.select("grid_id", "row", "col", F.when(F.col("n") == 4, F.col("z")).cast("float").alias(value))


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(route_id, part, seq, x, y) from `events`: one route per user, vertices hashed into 500 x 400 m and beyond."""
    from pyspark.sql import Window

    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    x, y = (F.col("event_id") * 7919 % 520).cast("double"), (F.col("event_id") * 104729 % 420).cast("double")
    return e.select(F.col("user_id").alias("route_id"), F.lit(0).alias("part"), (F.row_number().over(w) - 1).alias("seq"), x.alias("x"), y.alias("y"))


__all__ = ["derived", "meta_of", "write_grid", "read_grid", "read_window", "sample_bands", "geographic_window", "routes", "utm_forward"]
