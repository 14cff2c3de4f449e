"""GeoTIFF round trip, terrain products, stored regions, infrastructure runout."""

import math
import tomllib
from dataclasses import asdict, replace

import pytest
from pyspark.sql import functions as F

from cirque import api, config, model
from cirque.operators import infrastructure, region, release, tiles
from cirque.plans import manifest, registry, terrain
from cirque.sources import geotiff, grids

META = model.GridMeta(500000, 4500000, 10, 10, 300, 20, 32613)


def cells(spark):
    return spark.range(6000).selectExpr("0L as grid_id", "cast(id div 20 as int) as row", "cast(id % 20 as int) as col", "cast(if(id % 7 = 0, null, id % 5) as smallint) as exposure", "cast(id / 3.0 as float) as dem")


def test_geotiff(spark, tmp_path):
    for bands in (["exposure"], ["exposure", "dem"]):
        geotiff.write(cells(spark), bands, META, str(tmp_path / "x.tif"), {"tool": "a & b"})
        got, meta = geotiff.read(spark, str(tmp_path / "x.tif"))
        want = cells(spark).select("row", "col", *[F.col(b).cast("double").alias(b) for b in bands])
        assert meta == META and got.select("row", "col", *[F.col(b).cast("double").alias(b) for b in bands]).exceptAll(want).isEmpty() and got.count() == 6000
    assert b"avalanche forecast" in (tmp_path / "x.tif").read_bytes()
    assert geotiff.overviews(cells(spark), 1).count() == 1500


def test_products(spark, tmp_path):
    d = cells(spark).withColumn("dem", (1000 + 5 * F.col("row")).cast("double"))
    out, meta = terrain.area(d, META, 20)
    assert (meta.rows, meta.cols) == (296, 16) and out.count() == 296 * 16
    x, y = META.pixel_center(100, 10)
    p = terrain.point(d, META, x, y).first()
    whole = out.where("row = 98 and col = 8").first()
    assert abs(p["slope"] - math.degrees(math.atan(0.5))) < 1e-4 and p["slope_class"] == whole["slope_class"]
    assert terrain.check_slope(out, out) and not terrain.check_slope(out, out.withColumn("slope", F.col("slope") + 1))
    terrain.save_region(out.withColumn("exposure", F.lit(2)), meta, str(tmp_path), "b")
    r = terrain.load_regions(spark, str(tmp_path), ["b"])
    assert api.point(r, x, y)["class"] == 2 and api.point(r, x, y)["elevation_m"] == 1500.0


def test_infrastructure(spark):
    """A gully with a building in it: the cells of the gully down to it have its value, what starts elsewhere has none."""
    z = lambda r, c: 1800.0 - 9 * min(r, 18) - 0.5 * r + 60 * abs(c - 6)
    starts, building = ((1, 6), (4, 6), (30, 2)), (12, 6)
    rows = [(0, r, c, z(r, c), int((r, c) in starts), 3.0 if (r, c) == building else 0.0) for r in range(35) for c in range(13)]
    d = spark.createDataFrame(rows, "grid_id long, row int, col int, dem double, start int, infra double")
    out = infrastructure.runout_infrastructure(d, "dem", "start", "infra", model.GridMeta(0, 350, 10, 10, 35, 13), config.FlowParams(alpha=42))
    hit = {(r["row"], r["col"]) for r in out.where("backcalculation = 3").collect()}
    assert hit == {(r, 6) for r in range(1, 13)} and out.where("backcalculation not in (0, 3)").count() == 0


def test_mosaic(spark, tmp_path):
    d = cells(spark)
    for name, lo, hi in (("a", 0, 200), ("b", 150, 300)):
        part = d.where(F.col("row").between(lo, hi - 1)).withColumn("row", F.col("row") - lo)
        part = part.withColumn("dem", F.lit(-1.0).cast("float")) if name == "a" else part
        grids.write_grid(part, str(tmp_path / name), replace(META, y0=META.y0 - 10 * lo, rows=hi - lo))
    out, meta = grids.mosaic(spark, str(tmp_path / "{tile}"), ["a", "b"])
    assert meta == META and out.count() == 6000 and out.where("dem = -1").count() == 150 * 20
    assert out.select("row", "col", "exposure").exceptAll(d.select("row", "col", "exposure")).isEmpty()
    with pytest.raises(FileNotFoundError, match="tile c"):
        grids.mosaic(spark, str(tmp_path / "{tile}"), ["a", "c"])
    grids.write_grid(d, str(tmp_path / "off"), replace(META, x0=META.x0 + 3))
    with pytest.raises(ValueError, match="tile off"):
        grids.mosaic(spark, str(tmp_path / "{tile}"), ["a", "off"])


def test_manifest(spark):
    p = config.Config('schema_version = 1\n[prep]\npad_m = 500\nname = "a \\"b\\""').params()
    got = tomllib.loads(manifest.manifest("r", cells(spark), META, p, [region.Attempt(500.0, 3, 900.5, False), region.Attempt(1500.0, 3, 900.5, True)], {"dem": 1.5}))
    assert got["attempts"][1] == {"pad_m": 1500.0, "release_cells": 3, "max_runout_m": 900.5, "sufficient": True} and got["sufficient_pad"]
    assert got["classify"] == asdict(p.classify) and got["prep"] == {"pad_m": 500, "name": 'a "b"'} and got["grid"]["rows"] == 300
    assert got["class_cells"]["nodata"] == 858 and sum(got["class_cells"].values()) == 6000 and got["timings_s"] == {"dem": 1.5}


def test_split_release(spark):
    d = cells(spark).withColumn("start", F.when(F.col("row") < F.col("col"), 1).otherwise(0))
    got = release.split_release(d, "start", 4)
    assert got.count() == d.where("start = 1").count() == 190 and [r["n"] for r in got.groupBy("piece").agg(F.count("*").alias("n")).orderBy("piece").collect()] == [55, 50, 48, 37]
    assert release.split_release(d.where("row > col"), "start", 4).count() == 0 and release.split_release(d, "start", 1).agg(F.max("piece")).first()[0] == 0


def test_directory_of_every_customer(spark):
    sf = "/root/testdata/sf0.1"
    keys = [r[0] for r in spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey").collect()]
    body = {tiles.hilbert(20, k % 64 + 64 * (k // 4096 % 16384), k % 4096 // 64 + 64 * (k // 67108864)): k % 7 for k in keys}
    assert len(body) == len(keys) > 4096
    place, want = {}, []
    for i in sorted(body):
        at = place.setdefault(body[i], len(place))
        if want and want[-1][0] + want[-1][1] == i and want[-1][2] == at:
            want[-1][1] += 1
        else:
            want.append([i, 1, at, 1])
    got = [list(r) for r in registry.Q["pmtiles_directory"](spark, sf).orderBy("first_id").collect()]
    assert got == want and sum(r[1] for r in got) == len(keys)
