"""The rule classifier: slope, runout, overhead, forest and release classes merged and cleaned."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, functions as F

from ..config import ClassifyParams
from ..model import GridMeta
from ..session import materialise
from .local import combine, count_class, forest_code, overhead, release_code, runout_class, slope_classes, slope_weight_area, truncated
from .zonal import cluster_mask, fill_nodata, label, numbered


class Classifier(Protocol):
    def __call__(self, cells: DataFrame, meta: GridMeta) -> DataFrame: ...


NEEDED = ("dem", "slope", "forest", "travel_angle", "overhead", "pra")


def merged_classes(cells: DataFrame, meta: GridMeta, p: ClassifyParams) -> DataFrame:
    """Every intermediate up to the lookup."""
    missing = [c for c in NEEDED if c not in cells.columns]
    if missing:
        raise ValueError(f"missing layers: {missing}")
    d = slope_classes(cells, "slope", p, meta.rows, meta.cols)
    d = d.withColumns({
        "runout_class": runout_class(truncated(F.col("travel_angle")), p), "count_class": count_class(truncated(F.col("overhead")), p),
        "forest_code": forest_code(truncated(F.col("forest")), p), "release_code": release_code(truncated(F.col("pra"))),
    })
    d = d.withColumn("merge_max", F.greatest("slope_class", "runout_class", "count_class"))
    return d.withColumn("merge_all", combine(F.col("merge_max"), F.col("forest_code"), F.col("release_code")))


def classify(cells: DataFrame, meta: GridMeta, p: ClassifyParams = ClassifyParams(), oracle_parity: bool = False, fill: Callable | None = fill_nodata) -> DataFrame:
    """cells with all intermediates and `exposure`. fill: the island filler, or None to leave islands empty.

    Parity mode gives null for class 0; otherwise null where elevation or forest have no data.
    """
    # written once each: labelling and counting read them several times, and behind them are windows over the grid
    d = materialise(merged_classes(cells, meta, p).withColumn("_shifted", F.least(F.lit(32767), F.col("merge_all") + 1)), "classify-merged")
    least = slope_weight_area(meta.dx, meta.dy, p.isl_size_m2)
    d = cluster_mask(numbered(materialise(label(d, "_shifted", meta.cols), "classify-labels")), least).withColumn("_held", F.when(F.col("keep"), F.col("_shifted")))
    d = fill(d, "_held", "keep", least / 4, "_filled") if fill else d.withColumn("_filled", F.col("_held"))
    exposure = F.col("_filled") - 1
    exposure = F.when(exposure != 0, exposure) if oracle_parity else F.when(F.col("dem").isNotNull() & F.col("forest").isNotNull(), exposure)
    return d.withColumn("exposure", exposure.cast("int")).drop("_shifted", "_held", "_filled", "root", "label", "keep")


def with_overhead(cells: DataFrame, max_z: float, count_max: float | None = None) -> DataFrame:
    """Adds overhead; count_max defaults to the largest count of the grid (one row per grid, joined back)."""
    if count_max is not None:
        return cells.withColumn("overhead", overhead(F.col("cell_count"), F.col("z_delta"), F.lit(float(count_max)), max_z))
    top = cells.groupBy("grid_id").agg(F.max(F.when(~F.isnan("cell_count"), F.col("cell_count"))).alias("_top"))
    return cells.join(top, "grid_id").withColumn("overhead", overhead(F.col("cell_count"), F.col("z_delta"), F.col("_top"), max_z)).drop("_top")
