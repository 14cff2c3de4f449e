"""Components, island clean-up and sieve.

Components are found by tile (an Arrow kernel sees a tile only), then the labels that
touch across tile borders are merged by randomised contraction; no task holds a grid.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..model import GridMeta
from ..session import materialise
from .components import components
from .order import in_order, running

TILE = 256
N4, N8 = ((-1, 0), (0, -1)), ((-1, 0), (-1, -1), (-1, 1), (0, -1))  # N W / N NW NE W


def tile_labels(v: np.ndarray, known: np.ndarray, eight: bool) -> np.ndarray:
    """First linear index of each cell's component of equal values (-1 where unknown)."""
    rows, cols = v.shape
    parent = np.arange(rows * cols)

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for dr, dc in N8 if eight else N4:
        a = (slice(-dr, None), slice(max(0, -dc), cols - max(0, dc)))
        b = (slice(0, rows + dr), slice(max(0, dc), cols - max(0, -dc)))
        same = (v[a] == v[b]) & known[a] & known[b]
        ids = np.arange(rows * cols).reshape(rows, cols)
        for i, j in zip(ids[a][same].tolist(), ids[b][same].tolist()):
            x, y = find(i), find(j)
            if x != y:
                parent[max(x, y)] = min(x, y)
    root = np.fromiter(map(find, range(rows * cols)), np.int64, rows * cols).reshape(rows, cols)
    return np.where(known, root, -1)


def label(cells: DataFrame, value: str, cols: int, eight: bool = True, background: int | None = 0, tile: int = TILE) -> DataFrame:
    """cells with `root`: the smallest row * cols + col of the cell's component (null: background or null value)."""
    use = F.col(value).isNotNull() if background is None else F.col(value).isNotNull() & (F.col(value) != background)
    keyed = cells.select("grid_id", "row", "col", F.when(use, F.col(value).cast("long")).alias("_v")).where("_v is not null")
    keyed = keyed.withColumn("_tr", F.expr(f"row div {tile}")).withColumn("_tc", F.expr(f"col div {tile}"))

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = pdf["row"].min(), pdf["col"].min()
        r, c = (pdf["row"] - r0).to_numpy(), (pdf["col"] - c0).to_numpy()
        v, known = np.zeros((r.max() + 1, c.max() + 1), np.int64), np.zeros((r.max() + 1, c.max() + 1), bool)
        v[r, c], known[r, c] = pdf["_v"].to_numpy(), True
        root = tile_labels(v, known, eight)[r, c]
        w = v.shape[1]
        return pdf.assign(local=(root // w + r0) * cols + root % w + c0)[["grid_id", "row", "col", "_v", "local"]]

    local = materialise(keyed.groupBy("grid_id", "_tr", "_tc").applyInPandas(kernel, "grid_id long, row int, col int, _v long, local long"), "labels")
    # pairs of equal neighbours in different tiles; only cells at a tile's border take part
    border = local.where(F.expr(f"row % {tile} in (0, {tile - 1}) or col % {tile} in (0, {tile - 1})"))
    shifts = F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in (N8 if eight else N4)])
    moved = border.withColumn("s", F.explode(shifts)).select("grid_id", (F.col("row") + F.col("s.dr")).alias("row"), (F.col("col") + F.col("s.dc")).alias("col"), "_v", F.col("local").alias("other"))
    pairs = moved.join(border, ["grid_id", "row", "col", "_v"]).where("local <> other").select("grid_id", "local", "other").distinct()
    pairs = materialise(pairs, "label-pairs")
    if pairs.isEmpty():
        merged = local.withColumn("root", F.col("local"))
    else:
        width = 1 << 40  # a grid's cells are below; ids of all grids in one graph
        key = lambda c: F.col("grid_id") * width + F.col(c)
        found = components(pairs.select(key("local").alias("a"), key("other").alias("b"))).select(F.col("node").alias("_k"), (F.col("component") % width).alias("_root"))
        merged = local.withColumn("_k", key("local")).join(found, "_k", "left").withColumn("root", F.coalesce("_root", "local"))
    return cells.join(merged.select("grid_id", "row", "col", "root"), ["grid_id", "row", "col"], "left")


def numbered(labelled: DataFrame) -> DataFrame:
    """Adds `label`: 1.. in scan order of the components' first cells, 0 for background. The ranking
    is over one row per component, in ranges of them."""
    roots = labelled.where("root is not null").select("grid_id", "root").distinct()
    order = running(in_order(roots.withColumn("_at", F.struct("grid_id", "root")), "_at"), "_at", F.lit(1), "_rank")
    before = order.groupBy("grid_id").agg((F.min("_rank") - 1).alias("_before"))  # ranks of the grids before
    ranked = order.join(F.broadcast(before), "grid_id").select("grid_id", "root", (F.col("_rank") - F.col("_before")).cast("int").alias("label"))
    return labelled.join(ranked, ["grid_id", "root"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def cluster_mask(numbered_cells: DataFrame, min_cells: int) -> DataFrame:
    """Adds `keep`: the component has min_cells or more, and its label isn't 0, nor 0 in 16 bits."""
    sizes = numbered_cells.groupBy("grid_id", "label").agg(F.count("*").alias("_n"))
    d = numbered_cells.join(sizes, ["grid_id", "label"])
    return d.withColumn("keep", (F.col("_n") >= min_cells) & (F.col("label") != 0) & (F.col("label") % 65536 != 0)).drop("_n")


def sieve(cells: DataFrame, value: str, cols: int, threshold: int, eight: bool = True, name: str = "sieved") -> DataFrame:
    """Components of fewer than `threshold` cells take the value of their largest neighbour, or of the first
    large one along the chain of largest neighbours. Null cells belong to none.

    Among equal neighbours the first met in scan order wins (rank: cell, then N NW NE W). Chains are
    followed by pointer doubling on the component table.
    """
    lab = materialise(label(cells, value, cols, eight, background=None).select(*cells.columns, "root"), "sieve-labels")
    polys = lab.where("root is not null").groupBy("grid_id", "root").agg(F.count("*").alias("size"), F.first(value).alias("val"))
    shifts = [(-1, 0, 0), (-1, -1, 1), (-1, 1, 2), (0, -1, 3)] if eight else [(-1, 0, 0), (0, -1, 3)]
    away = F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc"), F.lit(k).alias("k")) for a, b, k in shifts])
    here = lab.where("root is not null").select("grid_id", "row", "col", "root")
    near = here.withColumn("s", F.explode(away)).select(
        "grid_id", (F.col("row") + F.col("s.dr")).alias("row"), (F.col("col") + F.col("s.dc")).alias("col"), F.col("root").alias("p"),
        ((F.col("row") * cols + F.col("col")) * 4 + F.col("s.k")).cast("long").alias("rank"),
    )
    touch = near.join(here.withColumnRenamed("root", "q"), ["grid_id", "row", "col"]).where("p <> q")
    both = touch.select("grid_id", "p", "q", "rank").unionByName(touch.select("grid_id", F.col("q").alias("p"), F.col("p").alias("q"), "rank"))
    first = both.groupBy("grid_id", "p", "q").agg(F.min("rank").alias("rank"))
    sized = first.join(polys.select("grid_id", F.col("root").alias("q"), "size"), ["grid_id", "q"])
    big = sized.groupBy("grid_id", "p").agg(F.max_by("q", F.struct("size", -F.col("rank"))).alias("big"))
    jump = polys.join(big.withColumnRenamed("p", "root"), ["grid_id", "root"], "left")
    large = F.col("size") >= threshold
    jump = materialise(jump.select("grid_id", "root", "val", large.alias("large"), F.when(large, F.col("root")).otherwise(F.coalesce("big", "root")).alias("to")), "sieve-jump")
    n = max(2, jump.count())
    for _ in range(int(np.ceil(np.log2(n))) + 1):
        ahead = jump.select("grid_id", F.col("root").alias("to"), F.col("to").alias("next"))
        moved = materialise(jump.join(ahead, ["grid_id", "to"]).select("grid_id", "root", "val", "large", F.col("next").alias("to")), "sieve-jump")
        done = moved.join(jump.select("grid_id", "root", F.col("to").alias("was")), ["grid_id", "root"]).where("to <> was").isEmpty()
        jump = moved
        if done:
            break
    ends = jump.select("grid_id", F.col("root").alias("to"), F.col("val").alias("_val"), F.col("large").alias("_large"))
    final = jump.join(ends, ["grid_id", "to"]).select("grid_id", "root", F.when(F.col("_large"), F.col("_val")).otherwise(F.col("val")).alias("_new"))
    return lab.join(final, ["grid_id", "root"], "left").withColumn(name, F.coalesce("_new", value)).drop("_new", "root")


def fill_nodata(cells: DataFrame, value: str, keep: str, radius: float, name: str, tile: int = 64) -> DataFrame:
    """Cells that aren't kept take the inverse-distance mean of the nearest kept cell in each quadrant within
    `radius` cells, rounded; null if there is none. By tiles with a halo of the radius."""
    halo = int(np.ceil(radius))
    near = lambda c: F.sequence(F.expr(f"cast(floor(({c} - {halo}) / {tile}) as int)"), F.expr(f"cast(floor(({c} + {halo}) / {tile}) as int)"))
    spread = cells.select("grid_id", "row", "col", F.col(value).cast("double").alias("_v"), F.col(keep).alias("_k"), F.explode(near("row")).alias("_tr"), near("col").alias("_tcs"))
    spread = spread.withColumn("_tc", F.explode("_tcs")).drop("_tcs")

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        tr, tc = pdf["_tr"].iat[0], pdf["_tc"].iat[0]
        own = pdf[(pdf["row"] // tile == tr) & (pdf["col"] // tile == tc)]
        src = pdf[pdf["_k"] & pdf["_v"].notna()]
        sr, sc, sv = (src[c].to_numpy() for c in ("row", "col", "_v"))
        out = own["_v"].to_numpy(copy=True)
        for i in np.flatnonzero(~own["_k"].to_numpy()):
            dr, dc = sr - own["row"].iat[i], sc - own["col"].iat[i]
            d2 = dr * dr + dc * dc
            near_, total, weight = d2 <= radius * radius, 0.0, 0.0
            for q in ((dr <= 0) & (dc < 0), (dr < 0) & (dc >= 0), (dr >= 0) & (dc > 0), (dr > 0) & (dc <= 0)):
                at = np.flatnonzero(q & near_)
                if len(at):
                    k = at[np.argmin(d2[at])]
                    w = 1 / np.sqrt(d2[k])
                    total, weight = total + w * sv[k], weight + w
            out[i] = np.rint(total / weight) if weight else np.nan
        return pd.DataFrame({"grid_id": own["grid_id"], "row": own["row"], "col": own["col"], "_f": pd.Series(out, index=own.index)})

    filled = spread.groupBy("grid_id", "_tr", "_tc").applyInPandas(kernel, "grid_id long, row int, col int, _f double")
    filled = filled.withColumn(name, F.when(F.isnan("_f"), None).otherwise(F.col("_f")).cast("int")).drop("_f")
    return cells.join(filled, ["grid_id", "row", "col"], "left")


def inside_cells(cells: DataFrame, edges: DataFrame, meta: GridMeta) -> DataFrame:
    """The cells whose centre is inside any polygon, each once, by the even-odd rule over all rings of 3 points or more.

    edges (poly_id, ring, seq, x1, y1, x2, y2). Scan lines: an edge is spread over the rows it crosses, the
    crossings of a row are joined to its cells by the row (equi-join), and parity decides.
    """
    y = F.lit(meta.y0) - (F.col("_row") + 0.5) * meta.dy
    to_row = lambda v: (F.lit(meta.y0) - v) / meta.dy - 0.5
    top, bottom = F.ceil(to_row(F.greatest("y1", "y2")) - 1e-9), F.floor(to_row(F.least("y1", "y2")) + 1e-9)
    real = edges.groupBy("poly_id", "ring").agg(F.count("*").alias("_n")).where("_n >= 3").drop("_n")
    e = edges.join(real, ["poly_id", "ring"]).where("y1 <> y2")
    e = e.withColumn("_a", F.greatest(F.lit(0), top)).withColumn("_b", F.least(F.lit(meta.rows - 1), bottom)).where("_a <= _b")
    e = e.withColumn("_row", F.explode(F.sequence("_a", "_b"))).withColumn("_y", y).where((F.col("y1") > F.col("_y")) != (F.col("y2") > F.col("_y")))
    cross = e.withColumn("_x", (F.col("x2") - F.col("x1")) * (F.col("_y") - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1"))
    lines = cross.groupBy("_row", "poly_id").agg(F.collect_list("_x").alias("_xs"))  # as many as the polygon's edges
    lines = lines.groupBy("_row").agg(F.collect_list("_xs").alias("_lines"))
    x = F.lit(meta.x0) + (F.col("col") + 0.5) * meta.dx
    joined = cells.join(lines, cells["row"] == lines["_row"]).withColumn("_cx", x)
    hit = F.exists("_lines", lambda xs: F.size(F.filter(xs, lambda v: F.col("_cx") < v)) % 2 == 1)
    return joined.where(hit).select(*cells.columns)


def class_areas(cells: DataFrame, edges: DataFrame, value: str, meta: GridMeta) -> DataFrame:
    """(class, cells, area_m2) of the cells inside the polygons; null class: no data."""
    got = inside_cells(cells, edges, meta)
    return got.groupBy(F.col(value).alias("class")).agg(F.count("*").alias("cells")).withColumn("area_m2", F.col("cells") * (meta.dx * meta.dy))


def trim(cells: DataFrame, n: int, rows: int, cols: int) -> DataFrame:
    """Without n border cells; at least a row and a column stay; indices start at 0 again."""
    r, c = min(n, (rows - 1) // 2), min(n, (cols - 1) // 2)
    kept = cells.where(F.col("row").between(r, rows - 1 - r) & F.col("col").between(c, cols - 1 - c))
    return kept.withColumns({"row": (F.col("row") - r).cast("int"), "col": (F.col("col") - c).cast("int")})
