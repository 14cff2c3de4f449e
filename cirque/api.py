"""The query functions of the service: health, regions, point, area, route, forecast.

They return plain dicts with the disclaimer; ApiError carries the status.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from .functions.scalars import CLASS_NAMES, SECTORS
from .model import DISCLAIMER, BBox, GridMeta
from .operators.route import evaluate, totals
from .operators.zonal import class_areas


class ApiError(Exception):
    def __init__(self, status: int, message: str):
        super().__init__(message)
        self.status, self.body = status, {"error": message, "disclaimer": DISCLAIMER}


@dataclass
class Region:
    """A build, its cells cached by the caller; lon/lat are projected by `project`."""

    name: str
    cells: DataFrame
    meta: GridMeta
    bounds: BBox


def health() -> dict:
    return {"status": "ok", "disclaimer": DISCLAIMER}


def regions(all_: list[Region]) -> dict:
    out = []
    for r in sorted(all_, key=lambda r: r.name):
        hist = {row["exposure"]: row["count"] for row in r.cells.groupBy("exposure").count().collect()}  # at most 6 rows
        out.append({"name": r.name, "rows": r.meta.rows, "cols": r.meta.cols, "epsg": r.meta.epsg, "classes": {CLASS_NAMES[k]: hist.get(k, 0) for k in range(5)}, "nodata": hist.get(None, 0)})
    return {"regions": out, "disclaimer": DISCLAIMER}


def pick(all_: list[Region], name: str | None, points: list[tuple[float, float]]) -> Region:
    """The named region, else the first with any of the points, else the only one."""
    ordered = sorted(all_, key=lambda r: r.name)
    if name is not None:
        for r in ordered:
            if r.name == name:
                return r
        raise ApiError(404, f"no such region: {name}")
    for r in ordered:
        if any(r.bounds.min_x <= x <= r.bounds.max_x and r.bounds.min_y <= y <= r.bounds.max_y for x, y in points):
            return r
    if len(ordered) == 1:
        return ordered[0]
    raise ApiError(404, "no region has this point")


def pick_any(all_: list[Region], name: str | None, vertices: DataFrame, x: str, y: str, what: str) -> Region:
    """The named region, else the first that any of the vertices is in, else the only one. One aggregate over the vertices."""
    within = [F.max((F.col(x).between(r.bounds.min_x, r.bounds.max_x) & F.col(y).between(r.bounds.min_y, r.bounds.max_y)).cast("int")).alias(f"r{k}") for k, r in enumerate(all_)]
    found = vertices.agg(F.count("*").alias("n"), *within).first()
    if not found["n"]:
        raise ApiError(400, f"no {what}")
    here = [r for k, r in enumerate(all_) if found[f"r{k}"] == 1]
    if name is None and here:
        return min(here, key=lambda r: r.name)
    return pick(all_, name, [])


def point(all_: list[Region], x: float, y: float, name: str | None = None) -> dict:
    if not (math.isfinite(x) and math.isfinite(y)):
        raise ApiError(400, "coordinates must be finite")
    r = pick(all_, name, [(x, y)])
    at = r.meta.cell_at(x, y)
    if at is None:
        raise ApiError(404, "outside the region")
    c = r.cells.where((F.col("row") == at[0]) & (F.col("col") == at[1])).first()
    v = c.asDict() if c else {}
    az = v.get("aspect")
    return {
        "region": r.name, "row": at[0], "col": at[1], "class": v.get("exposure"), "class_name": None if v.get("exposure") is None else CLASS_NAMES[v["exposure"]],
        "elevation_m": v.get("dem"), "slope_deg": v.get("slope"), "aspect": None if az is None else SECTORS[int((az + 22.5) // 45) % 8],
        "forest": v.get("forest"), "on_avalanche_path": None if v.get("travel_angle") is None else v["travel_angle"] > 0,
        "in_release_area": None if v.get("pra") is None else v["pra"] == 1, "overhead": v.get("overhead"), "disclaimer": DISCLAIMER,
    }


def area(all_: list[Region], edges: DataFrame, name: str | None = None) -> dict:
    r = pick_any(all_, name, edges, "x1", "y1", "polygon")
    rows = {x["class"]: x["area_m2"] for x in class_areas(r.cells, edges, "exposure", r.meta).collect()}  # at most 6 rows
    known = sum(v for k, v in rows.items() if k is not None)
    return {
        "region": r.name, "class_m2": {CLASS_NAMES[k]: rows.get(k, 0.0) for k in range(5)}, "nodata_m2": rows.get(None, 0.0),
        "class_share": {CLASS_NAMES[k]: rows.get(k, 0.0) / known if known else None for k in range(5)}, "disclaimer": DISCLAIMER,
    }


def route(all_: list[Region], vertices: DataFrame, name: str | None = None) -> dict:
    r = pick_any(all_, name, vertices, "x", "y", "route")
    s = evaluate(vertices, r.cells, r.meta).cache()
    summary = totals(s).first().asDict()
    return {"region": r.name, "summary": summary, "stretches": [x.asDict(True) for x in s.orderBy("route_id", "stretch").toLocalIterator()], "disclaimer": DISCLAIMER}
