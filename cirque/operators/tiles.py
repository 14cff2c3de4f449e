"""Map tiles and the PMTiles archive."""

from __future__ import annotations

import gzip
import json
import math
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import class_rgba, tile_id, tile_lat, tile_lon, tile_x, tile_y, utm_forward
from ..model import GridMeta
from .order import in_order, running, with_previous

SIDE = 256


def tile_range(west: float, south: float, east: float, north: float, z: int) -> tuple[int, int, int, int]:
    """(x0, y0, x1, y1), inclusive."""
    n = 1 << z

    def at(lon: float, lat: float) -> tuple[int, int]:
        r = math.radians(max(-85.05112878, min(85.05112878, lat)))
        x, y = (lon + 180) / 360 * n, (1 - math.asinh(math.tan(r)) / math.pi) / 2 * n
        return max(0, min(n - 1, math.floor(x))), max(0, min(n - 1, math.floor(y)))

    (x0, y0), (x1, y1) = at(west, north), at(east, south)
    return x0, y0, x1, y1


def default_zooms(native: int) -> range:
    return range(max(0, native - 4), native + 1)


def render(cells: DataFrame, value: str, meta: GridMeta, bounds: tuple[float, float, float, float], zooms: list[int], lon0: float) -> DataFrame:
    """(z, x, y, png): each pixel takes its nearest cell; fully transparent tiles are left out.

    Pixels are generated by Spark and joined to cells by (row, col); one task encodes one tile.
    """
    spark = cells.sparkSession
    spans = [(z, *tile_range(*bounds, z)) for z in zooms]
    t = spark.createDataFrame(spans, "z int, x0 int, y0 int, x1 int, y1 int")
    t = t.withColumn("x", F.explode(F.sequence("x0", "x1"))).withColumn("y", F.explode(F.sequence("y0", "y1")))
    px = t.withColumn("py", F.explode(F.sequence(F.lit(0), F.lit(SIDE - 1)))).withColumn("px", F.explode(F.sequence(F.lit(0), F.lit(SIDE - 1))))
    lon = tile_lon(F.col("x") + (F.col("px") + 0.5) / SIDE, F.col("z"))
    lat = tile_lat(F.col("y") + (F.col("py") + 0.5) / SIDE, F.col("z"))
    e, n = utm_forward(F.col("_lon"), F.col("_lat"), F.lit(lon0))
    px = px.withColumns({"_lon": lon, "_lat": lat}).withColumns({"_e": e, "_n": n})
    px = px.withColumns({"row": F.floor((meta.y0 - F.col("_n")) / meta.dy).cast("int"), "col": F.floor((F.col("_e") - meta.x0) / meta.dx).cast("int")})
    c = cells.select("row", "col", class_rgba(F.col(value)).alias("rgba")).where("rgba <> 0")
    hit = px.join(c, ["row", "col"]).select("z", "x", "y", "px", "py", "rgba")
    return hit.groupBy("z", "x", "y").applyInPandas(_encode, "z int, x int, y int, png binary")


def _encode(pdf: pd.DataFrame) -> pd.DataFrame:
    img = np.zeros((SIDE, SIDE), ">u4")
    img[pdf["py"].to_numpy(), pdf["px"].to_numpy()] = pdf["rgba"].to_numpy()
    return pd.DataFrame({"z": [pdf["z"].iat[0]], "x": [pdf["x"].iat[0]], "y": [pdf["y"].iat[0]], "png": [png(img.view(np.uint8).reshape(SIDE, SIDE, 4))]})


def png(rgba: np.ndarray) -> bytes:
    """Lossless PNG of height x width x 4 bytes."""
    h, w, _ = rgba.shape
    raw = np.concatenate((np.zeros((h, 1), np.uint8), rgba.reshape(h, w * 4)), axis=1).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 9)) + chunk(b"IEND", b"")


#: Bytes of distinct tiles in an archive that the driver makes.
MAX_BYTES = 256 << 20


def directory(tiles: DataFrame, content: str) -> DataFrame:
    """(first_id, run, offset, length, hash): identical contents stored once, runs of consecutive ids merged."""
    t = tiles.select(tile_id(F.col("z"), F.col("x"), F.col("y")).alias("id"), F.sha2(F.col(content), 256).alias("hash"), F.length(content).cast("long").alias("length"))
    if t.groupBy("id").count().where("count > 1").limit(1).count():
        raise ValueError("a tile comes twice")
    first = t.groupBy("hash").agg(F.min("id").alias("_at"), F.first("length").alias("length"))
    stored = running(in_order(first, "_at"), "_at", F.col("length"), "_end").select("hash", (F.col("_end") - F.col("length")).alias("offset"))
    d = with_previous(in_order(t, "id"), "id", ["id", "hash"])
    new = F.when((F.col("prev_hash") == F.col("hash")) & (F.col("prev_id") == F.col("id") - 1), 0).otherwise(1)
    runs = running(d, "id", new, "_run").groupBy("_run").agg(F.min("id").alias("first_id"), F.count("*").alias("run"), F.first("hash").alias("hash"), F.first("length").alias("length"))
    return runs.join(stored, "hash").select("first_id", "run", "offset", "length", "hash")


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def write_pmtiles(tiles: DataFrame, content: str, bounds: tuple[float, float, float, float], metadata: dict, tile_type: int = 2) -> bytes:
    """A PMTiles v3 archive, made on the driver: its distinct contents are at most MAX_BYTES (checked beforehand), its
    root directory at most 16 KiB."""
    if (size := tiles.groupBy(F.sha2(F.col(content), 256)).agg(F.first(F.length(content)).alias("n")).agg(F.sum("n")).first()[0] or 0) > MAX_BYTES:
        raise ValueError(f"{size} bytes of tiles: more than an archive made on the driver may have")
    rows = directory(tiles, content).orderBy("first_id").collect()
    if not rows:
        raise ValueError("no tiles")
    blobs = {r["hash"]: bytes(r["blob"]) for r in tiles.groupBy(F.sha2(F.col(content), 256).alias("hash")).agg(F.first(content).alias("blob")).toLocalIterator()}
    parts, seen, at = [], {}, 0
    for r in rows:
        if r["hash"] not in seen:
            seen[r["hash"]] = at
            parts.append(blobs[r["hash"]])
            at += len(parts[-1])
    data = b"".join(parts)
    ids = [r["first_id"] for r in rows]
    raw = _varint(len(rows)) + b"".join(_varint(b - a) for a, b in zip([0, *ids], ids)) + b"".join(_varint(r["run"]) for r in rows) + b"".join(_varint(r["length"]) for r in rows)
    end = None
    for r in rows:
        at = seen[r["hash"]]
        raw += _varint(0 if at == end else at + 1)
        end = at + r["length"]
    root, meta = gzip.compress(raw, mtime=0), gzip.compress(json.dumps(metadata).encode(), mtime=0)
    if len(root) > 16384 - 127:
        raise ValueError("the root directory is larger than 16 KiB")
    z = tiles.agg(F.min("z").alias("a"), F.max("z").alias("b")).first()
    e7 = [round(v * 1e7) for v in bounds]
    head = b"PMTiles\x03" + struct.pack("<11Q", 127, len(root), 127 + len(root), len(meta), 0, 0, 127 + len(root) + len(meta), len(data), sum(r["run"] for r in rows), len(rows), len(seen))
    head += bytes([1, 2, 1, tile_type, z["a"], z["b"]]) + struct.pack("<4i", *e7) + bytes([z["a"]]) + struct.pack("<2i", (e7[0] + e7[2]) // 2, (e7[1] + e7[3]) // 2)
    return head + root + meta + data


def read_tile(archive: bytes, z: int, x: int, y: int) -> bytes | None:
    """One tile of an archive, or None."""
    root_at, root_len, *_ = struct.unpack_from("<11Q", archive, 8)
    data_at = struct.unpack_from("<11Q", archive, 8)[6]
    raw, pos = gzip.decompress(archive[root_at : root_at + root_len]), 0

    def number() -> int:
        nonlocal pos
        n = shift = 0
        while True:
            b = raw[pos]
            pos += 1
            n |= (b & 127) << shift
            if b < 128:
                return n
            shift += 7

    n = number()
    ids, at = [], 0
    for _ in range(n):
        at += number()
        ids.append(at)
    runs, lengths = [number() for _ in range(n)], [number() for _ in range(n)]
    offsets: list[int] = []
    for k in range(n):
        v = number()
        offsets.append(offsets[-1] + lengths[k - 1] if v == 0 else v - 1)
    want = hilbert(z, x, y)
    for i, r, o, length in zip(ids, runs, offsets, lengths):
        if i <= want < i + r:
            return archive[data_at + o : data_at + o + length]
    return None


def hilbert(z: int, x: int, y: int) -> int:
    """Tile id on the driver."""
    d, s = 0, 1 << z >> 1
    while s:
        rx, ry = int(x & s > 0), int(y & s > 0)
        d += s * s * (3 * rx ^ ry)
        if not ry:
            if rx:
                x, y = s - 1 - x, s - 1 - y
            x, y = y, x
        s >>= 1
    return d + (4**z - 1) // 3
