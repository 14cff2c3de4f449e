"""Terrain products over a padded window: area, point, the slope self-check, and stored builds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import ClassifyParams
from ..model import BBox, GridMeta
from ..operators.compare import agreement
from ..operators.focal import terrain
from ..operators.local import slope_classes
from ..operators.zonal import trim
from ..sources.grids import read_grid, write_grid


def area(cells: DataFrame, meta: GridMeta, pad_m: float, p: ClassifyParams = ClassifyParams(), dem: str = "dem") -> tuple[DataFrame, GridMeta]:
    """slope, aspect and slope_class of a window, computed on all of it and trimmed by floor(pad / cell)."""
    if pad_m < 0:
        raise ValueError("pad must not be negative")
    d = slope_classes(terrain(cells, dem, meta.dx, meta.dy, meta.rows, meta.cols), "slope", p, meta.rows, meta.cols)
    n = int(pad_m / meta.dx)
    return trim(d, n, meta.rows, meta.cols), meta.trimmed(n)


def point(cells: DataFrame, meta: GridMeta, x: float, y: float, p: ClassifyParams = ClassifyParams()) -> DataFrame:
    """One row: elevation, slope, aspect and class proxy at a coordinate; no row outside.

    Only the cells that the answer depends on are read: the 3 x 3 stencil and the smoothing window around.
    """
    at = meta.cell_at(x, y)
    if at is None:
        return cells.limit(0)
    reach = 1 + p.win_size // 2 + 1
    near = cells.where(F.col("row").between(at[0] - reach, at[0] + reach) & F.col("col").between(at[1] - reach, at[1] + reach))
    d = slope_classes(terrain(near, "dem", meta.dx, meta.dy, meta.rows, meta.cols), "slope", p, meta.rows, meta.cols)
    return d.where((F.col("row") == at[0]) & (F.col("col") == at[1])).select("row", "col", "dem", "slope", "aspect", "slope_class")


def check_slope(ours: DataFrame, other: DataFrame, value: str = "slope", tolerance: float = 1e-3) -> bool:
    """Do two slope grids agree within a tolerance, with data in the same cells?"""
    r = agreement(ours, other, value).first()
    return r["compared"] > 0 and r["mismatched"] == 0 and r["max_diff"] <= tolerance


def save_region(cells: DataFrame, meta: GridMeta, root: str, name: str, provenance: dict | None = None) -> None:
    write_grid(cells, f"{root}/region={name}", meta, provenance)


def load_regions(spark: SparkSession, root: str, names: list[str]):
    """Builds by name, in order of the name, ready for api.*: slope and aspect are stored, not derived again."""
    from ..api import Region

    out = []
    for name in sorted(names):
        cells, meta = read_grid(spark, f"{root}/region={name}")
        box = BBox(meta.x0, meta.y0 - meta.rows * meta.dy, meta.x0 + meta.cols * meta.dx, meta.y0)
        out.append(Region(name, cells, meta, box))
    return out
