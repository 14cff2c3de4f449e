"""Grid metadata, boxes and the wording that every output carries."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

DISCLAIMER = "modeled terrain classification, not an avalanche forecast"
NODATA = -9999
MAX_CELLS = 100_000_000


@dataclass(frozen=True)
class BBox:
    min_x: float
    min_y: float
    max_x: float
    max_y: float

    @staticmethod
    def of(x1: float, y1: float, x2: float, y2: float) -> BBox:
        return BBox(min(x1, x2), min(y1, y2), max(x1, x2), max(y1, y2))

    def center(self) -> tuple[float, float]:
        return (self.min_x + self.max_x) / 2, (self.min_y + self.max_y) / 2

    def buffered(self, by: float) -> BBox:
        return BBox(self.min_x - by, self.min_y - by, self.max_x + by, self.max_y + by)


@dataclass(frozen=True)
class GridMeta:
    """North-up grid: x0, y0 is the outer corner of cell (0, 0); dx, dy are positive cell sizes."""

    x0: float
    y0: float
    dx: float
    dy: float
    rows: int
    cols: int
    epsg: int | None = None
    nodata: float | None = NODATA

    def __post_init__(self):
        if not all(map(math.isfinite, (self.x0, self.y0, self.dx, self.dy))) or self.dx <= 0 or self.dy <= 0:
            raise ValueError("cell sizes must be finite and above zero")

    def pixel_center(self, row: int, col: int) -> tuple[float, float]:
        return self.x0 + (col + 0.5) * self.dx, self.y0 - (row + 0.5) * self.dy

    def cell_at(self, x: float, y: float) -> tuple[int, int] | None:
        """Row and column; the right and bottom edges belong to no cell."""
        col, row = math.floor((x - self.x0) / self.dx), math.floor((self.y0 - y) / self.dy)
        return (row, col) if 0 <= row < self.rows and 0 <= col < self.cols else None

    def trim_width(self, n: int) -> tuple[int, int]:
        return min(n, (self.rows - 1) // 2), min(n, (self.cols - 1) // 2)

    def trimmed(self, n: int) -> GridMeta:
        r, c = self.trim_width(n)
        return replace(self, x0=self.x0 + c * self.dx, y0=self.y0 - r * self.dy, rows=self.rows - 2 * r, cols=self.cols - 2 * c)

    def aligned(self, other: GridMeta) -> bool:
        return (self.x0, self.y0, self.dx, self.dy, self.rows, self.cols, self.epsg) == (other.x0, other.y0, other.dx, other.dy, other.rows, other.cols, other.epsg)


def check_aligned(grids: list[GridMeta]) -> None:
    if not grids:
        raise ValueError("at least one band is needed")
    if not all(g.aligned(grids[0]) for g in grids):
        raise ValueError("bands differ in shape, transform or CRS")


def utm_epsg(lon: float, lat: float) -> int:
    """EPSG of the regular UTM zone; 180 degrees east is in zone 60."""
    if not (math.isfinite(lon) and math.isfinite(lat) and -180 <= lon <= 180 and -90 <= lat <= 90):
        raise ValueError("longitude or latitude out of range")
    zone = min(60, math.floor((lon + 180) / 6) + 1)
    return (32600 if lat >= 0 else 32700) + zone


def snapped_window(box: BBox, res: float) -> GridMeta:
    """The box expanded outward to multiples of res, of one cell at least and MAX_CELLS at most."""
    if not math.isfinite(res) or res <= 0:
        raise ValueError("resolution must be finite and above zero")
    x0, y1 = math.floor(box.min_x / res) * res, math.ceil(box.max_y / res) * res
    cols = max(1, round((math.ceil(box.max_x / res) * res - x0) / res))
    rows = max(1, round((y1 - math.floor(box.min_y / res) * res) / res))
    if rows * cols > MAX_CELLS:
        raise ValueError(f"{rows * cols} cells; at most {MAX_CELLS} are allowed")
    return GridMeta(x0, y1, res, res, rows, cols)


def degree_tiles(box: BBox) -> list[str]:
    """Names (north edge, west edge) of the one-degree tiles under a box, north to south, west to east."""
    out = []
    for north in range(math.ceil(box.max_y), math.floor(box.min_y), -1):
        for west in range(math.floor(box.min_x), math.ceil(box.max_x)):
            out.append(f"{'n' if north >= 0 else 's'}{abs(north):02d}{'e' if west >= 0 else 'w'}{abs(west):03d}")
    return out


def fnv1a64_hex(data: bytes) -> str:
    """FNV-1a, 64 bits (public offset basis and prime)."""
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 % 2**64
    return f"{h:016x}"


def export_url(base: str, box: BBox, rows: int, cols: int, epsg: int, function: str | None = None) -> str:
    """exportImage request for exactly this grid, of unsigned bytes as TIFF."""
    from urllib.parse import quote

    q = {
        "bbox": f"{box.min_x},{box.min_y},{box.max_x},{box.max_y}", "bboxSR": epsg, "imageSR": epsg, "size": f"{cols},{rows}",
        "format": "tiff", "pixelType": "U8", "interpolation": "RSP_NearestNeighbor", "f": "image",
    }
    if function:
        q["renderingRule"] = '{"rasterFunction":"' + function + '"}'
    return base.rstrip("/") + "/exportImage?" + "&".join(f"{k}={quote(str(v), safe='')}" for k, v in q.items())
