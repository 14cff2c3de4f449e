"""GeoTIFF: tiled, DEFLATE, one plane per band. Tiles are encoded on executors; the driver only strings them together.

Int16 with the horizontal predictor if every band is integral, else Float32. Written and read here without GDAL;
what this module writes it reads, with other files' tiles or strips as far as they use the same encodings.
"""

from __future__ import annotations

import struct
import zlib
from xml.sax.saxutils import escape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..model import DISCLAIMER, NODATA, GridMeta

SIDE = 256
INTEGRAL = {"smallint", "int", "tinyint"}


def _tiles(cells: DataFrame, bands: list[str], meta: GridMeta, whole: bool) -> DataFrame:
    kind = "<i2" if whole else "<f4"

    def encode(pdf: pd.DataFrame) -> pd.DataFrame:
        tr, tc = int(pdf["_tr"].iat[0]), int(pdf["_tc"].iat[0])
        r, c, out = pdf["row"].to_numpy() - tr * SIDE, pdf["col"].to_numpy() - tc * SIDE, []
        for k, b in enumerate(bands):
            img = np.full((SIDE, SIDE), NODATA, kind)
            v = pdf[b].to_numpy(dtype=float)
            img[r, c] = np.where(np.isnan(v), NODATA, np.clip(v, -32768, 32767) if whole else v).astype(kind)
            if whole:
                img[:, 1:] -= img[:, :-1].copy()
            out.append((tr, tc, k, zlib.compress(img.tobytes(), 6)))
        return pd.DataFrame(out, columns=["tr", "tc", "band", "data"])

    d = cells.select("row", "col", *[F.col(b).cast("double").alias(b) for b in bands], F.expr(f"row div {SIDE}").alias("_tr"), F.expr(f"col div {SIDE}").alias("_tc"))
    return d.groupBy("_tr", "_tc").applyInPandas(encode, "tr int, tc int, band int, data binary")


def write(cells: DataFrame, bands: list[str], meta: GridMeta, path: str, provenance: dict[str, str] | None = None) -> None:
    """One file on the driver's file system; cells of one grid."""
    whole = all(dict(cells.dtypes)[b] in INTEGRAL for b in bands)
    across, down = -(-meta.cols // SIDE), -(-meta.rows // SIDE)
    n = across * down
    offsets, counts = [0] * (n * len(bands)), [0] * (n * len(bands))
    items = [("disclaimer", DISCLAIMER), *(provenance or {}).items()]
    xml = "<GDALMetadata>" + "".join(f'<Item name="{escape(k)}">{escape(str(v))}</Item>' for k, v in items)
    xml += "".join(f'<Item name="DESCRIPTION" sample="{k}" role="description">{escape(b)}</Item>' for k, b in enumerate(bands)) + "</GDALMetadata>"
    with open(path, "wb") as out:
        out.write(struct.pack("<2sHI", b"II", 42, 0))
        for t in _tiles(cells, bands, meta, whole).toLocalIterator():
            k = t["band"] * n + t["tr"] * across + t["tc"]
            offsets[k], counts[k] = out.tell(), len(t["data"])
            out.write(bytes(t["data"]))
        s = len(bands)
        keys = [1, 1, 0, 3, 1024, 0, 1, 1, 1025, 0, 1, 1, 3072, 0, 1, meta.epsg or 32767]
        tags = [
            (256, "I", [meta.cols]), (257, "I", [meta.rows]), (258, "H", [16 if whole else 32] * s), (259, "H", [8]), (262, "H", [1]), (277, "H", [s]), (284, "H", [2]),
            (317, "H", [2 if whole else 1]), (322, "I", [SIDE]), (323, "I", [SIDE]), (324, "I", offsets), (325, "I", counts), (339, "H", [2 if whole else 3] * s),
            (33550, "d", [meta.dx, meta.dy, 0.0]), (33922, "d", [0.0, 0.0, 0.0, meta.x0, meta.y0, 0.0]), (34735, "H", keys), (42112, "s", xml.encode() + b"\0"), (42113, "s", f"{NODATA}\0".encode()),
        ]
        codes, entries, more = {"H": 3, "I": 4, "d": 12, "s": 2}, b"", b""
        start = out.tell() + out.tell() % 2
        room = start + 2 + 12 * len(tags) + 4
        for tag, kind, v in tags:
            data = v if kind == "s" else struct.pack(f"<{len(v)}{kind}", *v)
            if len(data) <= 4:
                value = data.ljust(4, b"\0")
            else:
                value = struct.pack("<I", room + len(more))
                more += data + b"\0" * (len(data) % 2)
            entries += struct.pack("<HHI", tag, codes[kind], len(v)) + value
        out.write(b"\0" * (start - out.tell()) + struct.pack("<H", len(tags)) + entries + struct.pack("<I", 0) + more)
        out.seek(4)
        out.write(struct.pack("<I", start))


def read(spark: SparkSession, path: str) -> tuple[DataFrame, GridMeta]:
    """(cells with one column per band, null where no data; meta). Tiles are decoded by tasks."""
    raw = open(path, "rb").read()
    at = struct.unpack_from("<I", raw, 4)[0]
    tags = {}
    sizes = {2: "s", 3: "H", 4: "I", 12: "d"}
    for k in range(struct.unpack_from("<H", raw, at)[0]):
        tag, code, n = struct.unpack_from("<HHI", raw, at + 2 + 12 * k)
        kind = sizes[code]
        size = n * struct.calcsize("<" + kind)
        where = at + 10 + 12 * k if size <= 4 else struct.unpack_from("<I", raw, at + 10 + 12 * k)[0]
        tags[tag] = raw[where : where + n] if kind == "s" else struct.unpack_from(f"<{n}{kind}", raw, where)
    cols, rows, bands = tags[256][0], tags[257][0], tags[277][0]
    across, down = -(-cols // SIDE), -(-rows // SIDE)
    whole = tags[339][0] == 2
    nodata = float(tags[42113].rstrip(b"\0"))
    xml = tags[42112].decode()
    names = [x.split("</Item>")[0].split(">", 1)[1] for x in xml.split("<Item ")[1:] if 'role="description"' in x]
    epsg = tags[34735][-1]
    meta = GridMeta(tags[33922][3], tags[33922][4], tags[33550][0], tags[33550][1], rows, cols, None if epsg == 32767 else epsg, nodata)
    blobs = [(k // across, k % across, [raw[tags[324][b * across * down + k] :][: tags[325][b * across * down + k]] for b in range(bands)]) for k in range(across * down)]
    kind = "smallint" if whole else "float"

    def decode(it):
        for pdf in it:
            for tr, tc, data in zip(pdf["tr"], pdf["tc"], pdf["data"]):
                h, w = min(SIDE, rows - tr * SIDE), min(SIDE, cols - tc * SIDE)
                r, c = np.mgrid[tr * SIDE : tr * SIDE + h, tc * SIDE : tc * SIDE + w].astype(np.int32)
                out = {"grid_id": np.zeros(h * w, np.int64), "row": r.ravel(), "col": c.ravel()}
                for name, blob in zip(names, data):
                    img = np.frombuffer(zlib.decompress(blob), "<i2" if whole else "<f4").reshape(SIDE, SIDE)
                    v = (np.cumsum(img, axis=1, dtype=np.int16) if whole else img)[:h, :w].ravel()
                    out[name] = pd.array(v, dtype="Int16" if whole else "Float32")
                    out[name][v == nodata] = pd.NA
                yield pd.DataFrame(out)

    t = spark.createDataFrame(blobs, "tr int, tc int, data array<binary>").repartition(max(1, min(200, len(blobs))))
    return t.mapInPandas(decode, "grid_id long, row int, col int, " + ", ".join(f"`{n}` {kind}" for n in names)), meta


def overviews(cells: DataFrame, level: int) -> DataFrame:
    """Nearest-neighbour overview: every 2**level-th cell."""
    k = 1 << level
    return cells.where((F.col("row") % k == 0) & (F.col("col") % k == 0)).withColumns({"row": F.expr(f"cast(row div {k} as int)"), "col": F.expr(f"cast(col div {k} as int)")})
