"""Gravity-flow runout from release cells.

The path from a release cell grows in an order that set operations can't express, so
it is a kernel. Cells are dealt to tiles with a halo; a tile's task follows the paths
of its own release cells and returns one record per cell it touched, so the shuffle after
it is bounded by cells, not by paths. A path that would leave its halo is an error
(`halo` too small), never a silent cut.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..config import FlowParams
from ..model import NODATA, GridMeta

#: Constants of the flow model. Fixed values.
NO_FRICTION_Z = 30**2 / (math.sqrt(2) * 9.8)
FRICTION_DEG, MIN_FRICTION_DEG = np.float32(10), np.float32(2)
MAX_DETRAINMENT, MIN_DETRAINMENT, MIN_FLUX = np.float32(0.0003), np.float32(0.00001), 0.0003
AROUND = [(r, c) for r in (-1, 0, 1) for c in (-1, 0, 1)]
RING = [0, 1, 2, 5, 8, 7, 6, 3]  # places of the eight neighbours in turn
STEP = np.array([math.sqrt(2) if r and c else 1.0 if r or c else 0.0 for r, c in AROUND])


class _Cell:
    __slots__ = ("row", "col", "alt", "around", "z", "flux", "parents", "far", "angle", "start", "forest")

    def __init__(self, row, col, alt, around, forest, z, flux):
        self.row, self.col, self.alt, self.around, self.forest, self.z, self.flux = row, col, alt, around, forest, z, flux
        self.parents: list[_Cell] = []
        self.far, self.angle, self.start = 0.0, 0.0, False


def _by_forest(cell: _Cell, most: np.float32, least: np.float32) -> float:
    """What forest adds at the cell's energy height: most of it at rest, falling to the least. Products with the
    forest are in single precision, the rest in double."""
    rest = most * cell.forest
    return max(float(least), float(rest - least) / -NO_FRICTION_Z * cell.z + float(rest))


def _friction(cell: _Cell, alpha: float) -> float:
    if not cell.forest > 0:
        return alpha
    return alpha + (max(0.0, _by_forest(cell, FRICTION_DEG, MIN_FRICTION_DEG)) if cell.z < NO_FRICTION_Z else float(MIN_FRICTION_DEG))


def _spread(cell: _Cell, first: _Cell, size: float, p: FlowParams) -> list[tuple[int, float, float]]:
    """(neighbour place, flux, z_delta) that a cell passes on; updates its flux, distance and angle."""
    drop = (cell.alt - cell.around).astype(np.float64)  # differences of elevations are in single precision
    z = np.clip(cell.z + drop - STEP * size * math.tan(math.radians(_friction(cell, p.alpha))), 0, p.max_z)
    if cell is first or first in cell.parents[:1]:
        keep = np.ones(9, np.float32)
    else:
        keep, block = np.zeros(9, np.float32), []
        for q in cell.parents:
            place = (q.row - cell.row + 1) * 3 + q.col - cell.col + 1
            block.append(place)
            k = RING.index((2 - place // 3) * 3 + 2 - place % 3)
            for at, share in ((k, 1.0), (k - 1, 0.707), ((k + 1) % 8, 0.707)):
                keep[RING[at]] = np.float32(float(keep[RING[at]]) + share * q.z)  # added in double, held in float
        keep[block] = 0
    lean = np.tan((np.arctan(drop / (np.where(STEP == 0, 1.0, STEP) * size)) + math.pi / 2) / 2)
    lean[(z <= 0) | (keep <= 0)] = 0
    lean[4] = 0
    terrain = lean**p.exponent
    if abs(lean.sum()) > 0:
        terrain = terrain / terrain.sum()
    # detrainment is at least the least, also where there is no forest
    cell.flux = max(MIN_FLUX, cell.flux - max(0.00001, _by_forest(cell, MAX_DETRAINMENT, MIN_DETRAINMENT)))
    if cell is not first:
        cell.far = min(math.hypot(q.row - cell.row, q.col - cell.col) * size + q.far for q in cell.parents)
        cell.angle = math.degrees(math.atan(float(first.alt - cell.alt) / cell.far))
    both = keep * terrain
    d = both / both.sum() * cell.flux if both.sum() > 0 else np.zeros(9)
    small = (d > 0) & (d < p.flux)
    n, mass = int(small.sum()), float(d[d < p.flux].sum())
    if mass > 0 and n > 0:
        d[d > p.flux] += mass / n
        d[d < p.flux] = 0
    if n > 0 and d.sum() < cell.flux:
        d[d > p.flux] += (cell.flux - d.sum()) / n
    return [(int(k), float(d[k]), float(z[k])) for k in np.flatnonzero(d > p.flux)]


class HaloTooSmall(ValueError):
    pass


def follow(dem: np.ndarray, wood: np.ndarray, row: int, col: int, size: float, p: FlowParams, open_sides: tuple[bool, bool, bool, bool]) -> list[_Cell]:
    """The cells of the path from one release cell; a cell that was passed before may come again."""
    rows, cols = dem.shape

    def make(r, c, z, flux):
        if not (1 <= r < rows - 1 and 1 <= c < cols - 1):
            if (r < 1 and open_sides[0]) or (r >= rows - 1 and open_sides[1]) or (c < 1 and open_sides[2]) or (c >= cols - 1 and open_sides[3]):
                raise HaloTooSmall("a path reaches the end of its tile's halo; use a larger one")
            return None
        around = dem[r - 1 : r + 2, c - 1 : c + 2].ravel()
        if np.isnan(around).any():
            return None
        return _Cell(r, c, around[4], around, wood[r, c], z, flux)

    first = make(row, col, 0.0, 1.0)
    if first is None:
        return []
    first.start = True
    path, place, at = [first], {(row, col): 0}, 0
    while at < len(path):
        cell = path[at]
        out = [(z, flux, cell.row + AROUND[k][0], cell.col + AROUND[k][1]) for k, flux, z in _spread(cell, first, size, p)]
        for z, flux, r, c in sorted(out):
            k = place.get((r, c), -1)
            if k >= at:
                known = path[k]
                known.flux += flux
                known.parents.append(cell)
                known.z = max(known.z, z)
            elif (new := make(r, c, z, flux)) is not None:
                new.parents.append(cell)
                place[(r, c)] = len(path)
                path.append(new)
        at += 1
    return path


def runout(cells: DataFrame, dem: str, release: str, forest: str | None, meta: GridMeta, p: FlowParams = FlowParams(), tile: int = 32, halo: int = 512) -> DataFrame:
    """cells with z_delta, flux, cell_count, z_delta_sum, travel_angle and flow_distance (FLOAT; 0 where no
    path came, distance 10000). forest is a fraction from 0 to 1; none is 0 everywhere, a gap in it the no-data value. Needs square cells.

    A tile's release cells are one task's work: `tile` sets the parallelism, halo the reach in cells.
    """
    if meta.dx != meta.dy:
        raise ValueError("runout needs square cells")
    # from the release tiles outwards: the tiles around each that its paths may reach are looked up, cells are dealt to those
    # only. Nothing is copied for tiles without release cells.
    own_tile = [F.expr(f"{c} div {tile}").cast("int").alias(t) for c, t in (("row", "_hr"), ("col", "_hc"))]
    start = cells.where((F.col(release) > 0) & F.col(dem).isNotNull()).select("grid_id", *own_tile).distinct()
    reach = -(-halo // tile)
    near = lambda c: F.sequence(F.greatest(F.lit(0), F.col(c) - reach), F.col(c) + reach)
    wanted = start.select("grid_id", F.col("_hr").alias("_tr"), F.col("_hc").alias("_tc"), F.explode(near("_hr")).alias("_hr"), "_hc").withColumn("_hc", F.explode(near("_tc")))
    thin = cells.select(
        "grid_id", "row", "col", F.col(dem).cast("float").alias("_z"), (F.lit(None) if forest is None else F.col(forest)).cast("float").alias("_w"),
        (F.col(release) > 0).alias("_rel"), *own_tile,
    )
    within = lambda c, t: F.col(c).between(F.col(t) * tile - halo, (F.col(t) + 1) * tile - 1 + halo)
    dealt = thin.join(wanted, ["grid_id", "_hr", "_hc"]).where(within("row", "_tr") & within("col", "_tc")).drop("_hr", "_hc")
    size, rows, cols = meta.dx, meta.rows, meta.cols

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        tr, tc = int(pdf["_tr"].iat[0]), int(pdf["_tc"].iat[0])
        r0, c0 = int(pdf["row"].min()), int(pdf["col"].min())
        r, c = (pdf["row"] - r0).to_numpy(), (pdf["col"] - c0).to_numpy()
        shape = (int(r.max()) + 1, int(c.max()) + 1)
        z, wood = np.full(shape, np.nan, np.float32), np.zeros(shape, np.float32)
        z[r, c] = pdf["_z"].to_numpy()
        if forest is not None:
            wood[r, c] = pdf["_w"].fillna(NODATA).to_numpy()
        open_sides = (r0 > 0, r0 + shape[0] < rows, c0 > 0, c0 + shape[1] < cols)
        own = pdf[pdf["_rel"].fillna(False) & (pdf["row"] // tile == tr) & (pdf["col"] // tile == tc) & pdf["_z"].notna()]
        own = own.sort_values(["_z", "row", "col"], ascending=False)
        acc: dict[tuple[int, int], list] = {}
        for rr, cc in zip(own["row"].tolist(), own["col"].tolist()):
            for x in follow(z, wood, rr - r0, cc - c0, size, p, open_sides):
                a = acc.get((x.row, x.col))
                if a is None:
                    acc[(x.row, x.col)] = [x.z, x.flux, 1, x.z, x.angle, x.far]
                else:
                    a[0], a[1], a[2], a[3] = max(a[0], x.z), max(a[1], x.flux), a[2] + 1, a[3] + x.z
                    a[4], a[5] = max(a[4], x.angle), min(a[5], x.far)
        out = pd.DataFrame([(k[0] + r0, k[1] + c0, *v) for k, v in acc.items()], columns=["row", "col", "z", "f", "n", "s", "a", "d"])
        out.insert(0, "grid_id", pdf["grid_id"].iat[0])
        return out

    parts = dealt.groupBy("grid_id", "_tr", "_tc").applyInPandas(kernel, "grid_id long, row int, col int, z double, f double, n long, s double, a double, d double")
    folded = parts.groupBy("grid_id", "row", "col").agg(
        F.max("z").alias("z_delta"), F.max("f").alias("flux"), F.sum("n").alias("cell_count"), F.sum("s").alias("z_delta_sum"), F.max("a").alias("travel_angle"), F.min("d").alias("flow_distance")
    )
    joined = cells.join(folded, ["grid_id", "row", "col"], "left")
    zero = {k: F.coalesce(F.col(k), F.lit(0)).cast("float") for k in ("z_delta", "flux", "cell_count", "z_delta_sum", "travel_angle")}
    return joined.withColumns({**zero, "flow_distance": F.least(F.coalesce("flow_distance", F.lit(10000.0)), F.lit(10000.0)).cast("float")})
