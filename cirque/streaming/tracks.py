"""Positions as a stream against a stored grid (the batch operators have no state, so they stream as they are)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..model import GridMeta
from ..operators.route import sample


def classified(positions: DataFrame, cells: DataFrame, meta: GridMeta) -> DataFrame:
    """Stream-static join: each position (.., ts, x, y) with the layers of its cell."""
    return sample(positions, cells, meta)


def exposure(positions: DataFrame, cells: DataFrame, meta: GridMeta, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Positions per user, window and class, with a watermark."""
    c = classified(positions, cells, meta).withWatermark("ts", late)
    return c.groupBy("user_id", F.window("ts", window), "exposure").agg(F.count("*").alias("positions"))
