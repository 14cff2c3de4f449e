"""Neighbourhood operators over cells (grid_id, row, col, value): one row per cell, dense grids.

The 3 x 3 stencil takes two window passes: lag/lead along a row packs (west, centre,
east), lag/lead of that along a column gives all nine. Two exchanges by (grid, row)
and (grid, col); no self-join.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

NINE = ("nw", "n", "ne", "w", "c", "e", "sw", "s", "se")


def _along(axis: str):
    """Window along a row (axis col) or a column (axis row)."""
    other = "row" if axis == "col" else "col"
    return Window.partitionBy("grid_id", other).orderBy(axis)


def stencil(cells: DataFrame, value: str) -> DataFrame:
    """cells with struct `nb` of the nine values; null outside the grid or where there is no data."""
    a, b = _along("col"), _along("row")
    trio = F.struct(F.lag(value).over(a).alias("w"), F.col(value).alias("c"), F.lead(value).over(a).alias("e"))
    rows = cells.withColumn("_t", trio)
    rows = rows.withColumn("_up", F.lag("_t").over(b)).withColumn("_down", F.lead("_t").over(b))
    parts = zip(NINE, [(r, k) for r in ("_up", "_t", "_down") for k in "wce"])
    return rows.withColumn("nb", F.struct(*[F.col(r)[k].alias(name) for name, (r, k) in parts])).drop("_t", "_up", "_down")


def _edges(rows: int, cols: int) -> dict[str, Column]:
    """The nine values with gaps filled: beyond the first or last row 2a - b of the two nearest rows (the
    column clamped), beyond a column 2a - b along the row, else the centre."""
    v = {k: F.col(f"nb.{k}").cast("float") for k in NINE}
    top, bottom = F.col("row") == 0, F.col("row") == rows - 1
    left, right = F.col("col") == 0, F.col("col") == cols - 1
    two = F.lit(2.0).cast("float")
    clamp = lambda k, mid, side: F.when(side, v[mid]).otherwise(v[k])
    line = {  # per row of the window: its three values with the column clamped
        r: (clamp(w, m, left), v[m], clamp(e, m, right)) for r, (w, m, e) in {"n": ("nw", "n", "ne"), "c": ("w", "c", "e"), "s": ("sw", "s", "se")}.items()
    }
    beyond_n = [two * a - b for a, b in zip(line["c"], line["s"])]
    beyond_s = [two * a - b for a, b in zip(line["c"], line["n"])]
    beyond_w = {r: two * v[m] - v[e] for r, (m, e) in {"n": ("n", "ne"), "c": ("c", "e"), "s": ("s", "se")}.items()}
    beyond_e = {r: two * v[m] - v[w] for r, (m, w) in {"n": ("n", "nw"), "c": ("c", "w"), "s": ("s", "sw")}.items()}
    out = {}
    for r, names in (("n", ("nw", "n", "ne")), ("c", ("w", "c", "e")), ("s", ("sw", "s", "se"))):
        for j, name in enumerate(names):
            x = v[name]
            if j != 1:
                x = F.when(left if j == 0 else right, (beyond_w if j == 0 else beyond_e)[r]).otherwise(x)
            if r != "c":
                x = F.when(top if r == "n" else bottom, (beyond_n if r == "n" else beyond_s)[j]).otherwise(x)
            out[name] = F.coalesce(x, v["c"])
    return out


def _horn(compute_edges: bool, rows: int, cols: int) -> tuple[Column, Column, Column]:
    """(dx, dy, usable): sums in FLOAT in the documented order, widened to DOUBLE."""
    if compute_edges:
        if rows < 2 or cols < 2:
            raise ValueError("edges need at least 2 x 2 cells")
        v, usable = _edges(rows, cols), F.col("nb.c").isNotNull()
    else:
        v = {k: F.col(f"nb.{k}").cast("float") for k in NINE}
        usable = F.lit(True)
        for k in NINE:
            usable = usable & F.col(f"nb.{k}").isNotNull()
    east, west = v["ne"] + v["e"] + v["e"] + v["se"], v["nw"] + v["w"] + v["w"] + v["sw"]
    south, north = v["sw"] + v["s"] + v["s"] + v["se"], v["nw"] + v["n"] + v["n"] + v["ne"]
    return (east - west).cast("double"), (south - north).cast("double"), usable


def horn_slope(cells: DataFrame, value: str, dx: float, dy: float, rows: int, cols: int, compute_edges: bool = False, name: str = "slope") -> DataFrame:
    """Slope in degrees (FLOAT); null at the border (edges off) and where the window has no data."""
    gx, gy, usable = _horn(compute_edges, rows, cols)
    s = F.degrees(F.atan(F.sqrt((gx / dx) * (gx / dx) + (gy / dy) * (gy / dy)) / 8)).cast("float")
    return stencil(cells, value).withColumn(name, F.when(usable, s)).drop("nb")


def horn_aspect(cells: DataFrame, value: str, rows: int, cols: int, compute_edges: bool = False, name: str = "aspect") -> DataFrame:
    """Azimuth that the slope faces (FLOAT); null where flat."""
    gx, gy, usable = _horn(compute_edges, rows, cols)
    a = F.degrees(F.atan2(gy, -gx)).cast("float")
    az = F.when(a > 90, F.lit(450.0).cast("float") - a).otherwise(F.lit(90.0).cast("float") - a)
    az = F.when(az == 360, F.lit(0.0).cast("float")).otherwise(az)
    return stencil(cells, value).withColumn(name, F.when(usable & ~((gx == 0) & (gy == 0)), az)).drop("nb")


def terrain(cells: DataFrame, value: str, dx: float, dy: float, rows: int, cols: int, compute_edges: bool = False) -> DataFrame:
    """Slope and aspect from one stencil."""
    gx, gy, usable = _horn(compute_edges, rows, cols)
    s = F.degrees(F.atan(F.sqrt((gx / dx) * (gx / dx) + (gy / dy) * (gy / dy)) / 8)).cast("float")
    a = F.degrees(F.atan2(gy, -gx)).cast("float")
    az = F.when(a > 90, F.lit(450.0).cast("float") - a).otherwise(F.lit(90.0).cast("float") - a)
    az = F.when(az == 360, F.lit(0.0).cast("float")).otherwise(az)
    flat = (gx == 0) & (gy == 0)
    return stencil(cells, value).withColumns({"slope": F.when(usable, s), "aspect": F.when(usable & ~flat, az)}).drop("nb")


def uniform_filter(cells: DataFrame, value: str, size: int, rows: int, cols: int, name: str) -> DataFrame:
    """Separable integer mean: along columns first, truncated, then along rows, truncated; edges repeat."""
    h = size // 2

    def one(df: DataFrame, src: str, axis: str, n: int, dst: str) -> DataFrame:
        w = _along(axis)
        total = F.sum(F.col(src).cast("long")).over(w.rowsBetween(-h, h))
        before, after = F.greatest(F.lit(0), h - F.col(axis)), F.greatest(F.lit(0), h - (n - 1 - F.col(axis)))
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        total = total + before * F.first(src).over(whole) + after * F.last(src).over(whole)
        return df.withColumn("_sum", total).withColumn(dst, F.expr(f"cast(_sum div {size} as int)")).drop("_sum")

    return one(one(cells, value, "row", rows, "_half"), "_half", "col", cols, name).drop("_half")


def gradient_slope(cells: DataFrame, value: str, cell: float, name: str = "slope") -> DataFrame:
    """Slope of central differences, one-sided at the edges; below -100 and no data count as -9999."""
    z = F.when(F.col(value).isNull() | F.isnan(F.col(value)) | (F.col(value) < -100), F.lit(-9999.0)).otherwise(F.col(value)).cast("float")

    def slope(axis: str) -> Column:
        w = _along(axis)
        back, ahead = F.lag("_z").over(w), F.lead("_z").over(w)
        return F.when(back.isNull(), (ahead - F.col("_z")) / cell).when(ahead.isNull(), (F.col("_z") - back) / cell).otherwise((ahead - back) / (2 * cell))

    d = cells.withColumn("_z", z).withColumn("_px", slope("row")).withColumn("_py", slope("col"))
    s = F.atan(F.sqrt(F.col("_px") * F.col("_px") + F.col("_py") * F.col("_py"))) * (180 / math.pi)
    return d.withColumn(name, s.cast("float")).drop("_z", "_px", "_py")


def sector(radius: int, direction: float = 0, tolerance: float = 180) -> list[tuple[int, int, float]]:
    """(row offset, column offset, distance in cells) within the radius and the wind sector."""
    low, high = math.radians(direction - tolerance + 270), math.radians(direction + tolerance + 270)
    out = []
    for r in range(-radius, radius + 1):
        for c in range(-radius, radius + 1):
            if (r, c) != (0, 0) and r * r + c * c <= radius * radius and (math.atan2(r, c) - low) % (2 * math.pi) <= high - low + 1e-12:
                out.append((r, c, math.sqrt(r * r + c * c)))
    return out


def windshelter(cells: DataFrame, value: str, cell: float, radius: int, rows: int, cols: int, prob: float = 0.5, direction: float = 0, tolerance: float = 180, name: str = "windshelter") -> DataFrame:
    """Quantile of atan((z - z0) / distance) over the sector; null in the border of `radius` cells, where
    the centre has no data, and without values. Zero elevation counts as no data.

    Rows of the sector come from lag/lead along columns of sorted arrays: each row of the window is a
    slice along the row, so a cell's neighbours arrive by two window passes whatever the radius.
    """
    z = F.when((F.col(value) != 0) & ~F.isnan(F.col(value)), F.col(value).cast("double"))
    a, b = _along("col"), _along("row")
    line = F.array(*[F.lag("_z", -k).over(a) if k < 0 else F.lead("_z", k).over(a) if k else F.col("_z") for k in range(-radius, radius + 1)])
    d = cells.withColumn("_z", z).withColumn("_l", line)
    d = d.withColumns({f"_r{k + radius}": F.lag("_l", -k).over(b) if k < 0 else F.lead("_l", k).over(b) if k else F.col("_l") for k in range(-radius, radius + 1)})
    angles = F.array(*[F.atan((F.col(f"_r{r + radius}")[c + radius] - F.col("_z")) / (dist * cell)) for r, c, dist in sector(radius, direction, tolerance)])
    d = d.withColumn("_a", F.sort_array(F.filter(angles, lambda x: x.isNotNull()))).drop("_l", *[f"_r{k}" for k in range(2 * radius + 1)])
    n = F.size("_a")
    at = (n - 1) * prob
    low = F.floor(at).cast("int")
    lo, hi, t = F.get("_a", low), F.get("_a", F.least(n - 1, low + 1)), at - low
    lerp = F.when(t >= 0.5, hi - (hi - lo) * (1 - t)).otherwise(lo + (hi - lo) * t)
    inside = F.col("row").between(radius, rows - 1 - radius) & F.col("col").between(radius, cols - 1 - radius)
    return d.withColumn(name, F.when(inside & F.col("_z").isNotNull() & (n > 0), lerp).cast("float")).drop("_z", "_a")
