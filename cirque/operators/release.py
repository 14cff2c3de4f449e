"""Potential release areas: slope, wind shelter and forest memberships, fuzzy combination, sieve."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from ..config import PraParams
from ..model import GridMeta
from ..session import materialise
from .focal import gradient_slope, windshelter
from .local import fuzzy, memberships
from .zonal import sieve


def release_areas(cells: DataFrame, dem: str, forest: str | None, meta: GridMeta, p: PraParams = PraParams()) -> DataFrame:
    """cells with pra_slope, windshelter, pra_continuous, pra_binary and pra (sieved). Needs square cells.

    Without a forest its value is 0 where the elevation is above -100. A missing wind shelter enters its
    membership as -9999, like the border.
    """
    if meta.dx != meta.dy:
        raise ValueError("release areas need square cells")
    radius = max(1, int(p.radius_m / meta.dx + 0.5))
    d = gradient_slope(cells, dem, meta.dx, "pra_slope")
    d = windshelter(d, dem, meta.dx, radius, meta.rows, meta.cols, p.prob, p.wind_dir, p.wind_tol)
    wood = F.when(F.col(dem) > -100, F.lit(0.0)).otherwise(F.col(dem)) if forest is None else F.col(forest)
    s, w, f = memberships(F.col("pra_slope"), F.coalesce(F.col("windshelter"), F.lit(-9999.0)), wood, p)
    d = d.withColumns({"_s": s, "_w": w, "_f": f})
    whole, binary = fuzzy(F.col("_s"), F.col("_w"), F.col("_f"), p.threshold)
    d = d.withColumns({"pra_continuous": whole, "pra_binary": binary}).drop("_s", "_w", "_f")
    d = materialise(d, "release-areas")  # the sieve reads it more than once
    return sieve(d, "pra_binary", meta.cols, p.sieve_cells + 1, True, "pra")


def split_release(cells: DataFrame, release: str, pieces: int) -> DataFrame:
    """(row, col, piece) of the release cells: bands of whole columns, each closed at the first column where it holds
    its share of all release cells; the last piece takes the rest. Only counts per column come to the driver."""
    if pieces < 1:
        raise ValueError("pieces must be at least 1")
    hot = cells.where(F.col(release) > 0).select("row", "col")
    counts = hot.groupBy("col").agg(F.count("*").alias("n")).orderBy("col").collect()  # at most one row per column
    share, held, piece, of = sum(r["n"] for r in counts) / pieces, 0, 0, []
    for r in counts:
        if held >= share and piece < pieces - 1:
            held, piece = 0, piece + 1
        held += r["n"]
        of.append((r["col"], piece))
    bands = cells.sparkSession.createDataFrame(of, T.StructType([T.StructField("col", T.IntegerType()), T.StructField("piece", T.IntegerType())]))
    return hot.join(F.broadcast(bands), "col").select("row", "col", "piece")  # bands: as many rows as columns
