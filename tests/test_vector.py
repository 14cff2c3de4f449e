"""Routes, files, forecasts, tiles, configuration, service functions and driver queries."""

import json
import math
import random
from datetime import datetime, timedelta, timezone

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from cirque import api, config, model
from cirque.functions import scalars as S
from cirque.operators import forecast, route, tiles
from cirque.plans import registry
from cirque.sources import files, grids
from cirque.streaming import tracks

META = model.GridMeta(200, 960, 20, 20, 8, 12)


def cells(spark):
    """8 x 12 cells of 20 m: classes by diagonal bands, elevations that grow by the cell."""
    return spark.range(96).selectExpr("0L as grid_id", "cast(id div 12 as int) as row", "cast(id % 12 as int) as col", "cast((id div 12 + id % 12) div 4 as int) as exposure", "1400D + 3 * id as dem")


def class_at(x, y):
    """The class of the cell under a place; -1 outside."""
    r, c = math.floor((960 - y) / 20), math.floor((x - 200) / 20)
    return (r + c) // 4 if 0 <= r < 8 and 0 <= c < 12 else -1


def line(spark, *pts):
    return spark.createDataFrame([(0, 0, i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "route_id long, part int, seq int, x double, y double")


def test_route_is_gaps_and_islands(spark):
    """A bent route against its pieces of 5 m, each by its middle: lengths and order of the stretches."""
    bends = [(210, 950), (430, 850), (330, 810)]
    got = route.evaluate(line(spark, *bends), cells(spark), META, 5).orderBy("stretch").collect()
    want, far = [], 0.0
    for (x1, y1), (x2, y2) in zip(bends, bends[1:]):
        length = math.hypot(x2 - x1, y2 - y1)
        n = max(1, math.ceil(length / 5))
        for k in range(n):
            c = class_at(x1 + (x2 - x1) * (k + 0.5) / n, y1 + (y2 - y1) * (k + 0.5) / n)
            if want and want[-1][0] == c:
                want[-1][2] += length / n
            else:
                want.append([c, far, far + length / n])
            far += length / n
            want[-1][2] = far
    assert [r["class"] for r in got] == [w[0] for w in want] and len(want) >= 4
    for r, (_, start, end) in zip(got, want):
        assert (r["start"], r["end"], r["length"]) == (pytest.approx(start), pytest.approx(end), pytest.approx(end - start))


def test_route_beyond_the_grid_and_over_gaps(spark):
    c = cells(spark).withColumn("exposure", F.when(~((F.col("row") == 2) & F.col("col").isin(3, 4)), F.col("exposure")))
    t = route.totals(route.evaluate(line(spark, (165, 910), (300, 910)), c, META, 5)).first()
    # 35 m before the grid, then columns 0 and 1 in class 0, 2 in class 1, 3 and 4 without a class
    assert (t["outside_m"], t["class0_m"], t["class1_m"], t["nodata_m"]) == (pytest.approx(35), pytest.approx(40), pytest.approx(20), pytest.approx(40))
    with pytest.raises(ValueError):
        route.segmentize(line(spark, (0, 0)), 0)


def test_route_geojson(spark):
    s = route.evaluate(line(spark, (210, 950), (290, 950)), cells(spark), META)
    assert [r["class"] for r in s.orderBy("stretch").collect()] == [0, 1]
    p = spark.createDataFrame([(0, 1, 0, 1.0, 2.0), (0, 1, 1, 1.5, 2.0), (0, 2, 0, 1.5, 2.0), (0, 2, 1, 2.0, 2.0)], "route_id long, stretch long, k int, lon double, lat double")
    j = json.loads(route.geojson(s, p).first()["json"])
    assert [f["properties"]["class"] for f in j["features"]] == [0, 1] and j["disclaimer"] == model.DISCLAIMER


def test_gpx_and_geojson(spark):
    t = spark.createDataFrame([(1, "<x:gpx><wpt lat='1' lon='1'/><trk><trkseg><trkpt lat='1.5' lon=\"2\"/><trkpt lon='3' lat='4'/></trkseg></trk><rte><rtept lat='0' lon='0'></rtept></rte></x:gpx>")], "route_id long, value string")
    assert [tuple(r) for r in files.gpx(t).orderBy("part", "seq").collect()] == [(1, 0, 0, 2.0, 1.5), (1, 0, 1, 3.0, 4.0), (1, 1, 0, 0.0, 0.0)]
    bad = spark.createDataFrame([(1, "<trkseg><trkpt lat='x' lon='2'/></trkseg>")], "route_id long, value string")
    with pytest.raises(Exception, match="bad point"):
        files.gpx(bad).collect()
    g = {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "GeometryCollection", "geometries": [{"type": "MultiLineString", "coordinates": [[[0, 0], [1, 1]], [[2, 2, 9], [3, 3]]]}]}}, {"type": "Feature", "geometry": {"type": "Point", "coordinates": [5, 5]}}]}
    got = files.geojson_lines(spark.createDataFrame([(7, json.dumps(g))], "route_id long, value string")).orderBy("part", "seq").collect()
    assert [(r["part"], r["lon"]) for r in got] == [(0, 0.0), (0, 1.0), (1, 2.0), (1, 3.0)]


def test_forecasts(spark):
    """Two forecasts and an advisory in one file: days, issue times with and without an offset, zones by polygon or area."""
    entry = lambda k, area, polygons, issued, ratings, problems: {
        "type": "avalancheforecast", "id": k, "areaId": area, "polygons": polygons, "issueDateTime": issued, "expiryDateTime": "2025-02-04T16:00:00",
        "dangerRatings": {"days": ratings}, "avalancheProblems": {"days": problems},
    }
    text = json.dumps([
        entry("north", "N1", ["p1", "p2"], "2025-02-03T16:30:00+01:00", [{"alp": "High", "tln": "moderate", "btl": "low"}, {"alp": "2", "tln": "", "btl": ""}], [[{"type": "wind", "aspectElevations": ["e_tln", "se_alp", "odd"]}]]),
        entry("south", "S1", [], "2025-02-03T16:30:00", [{"alp": "", "tln": "", "btl": ""}], []), {"type": "regional-discussion", "id": "x"},
    ])
    f = files.products(spark.createDataFrame([(text,)], "value string"))
    by = {r["id"]: r for r in f.collect()}
    assert set(by) == {"north", "south"} and len(by["north"]["days"]) == 2 and by["north"]["polygons"] == ["p1", "p2"]
    days = {(r["id"], r["day"]): r["highest"] for r in forecast.days(f).collect()}
    assert days["north", 0] == 4 and days["north", 1] == 2 and days["south", 0] is None
    issued = datetime(2025, 2, 3, 16, 30, tzinfo=timezone(timedelta(hours=1)))
    epochs = {r["id"]: r["e"] for r in f.select("id", S.epoch(F.col("issued")).alias("e")).collect()}
    assert epochs == {"north": int(issued.timestamp()), "south": None} and {r["expired"] for r in forecast.expired(f, 0).collect()} == {None}
    z = spark.createDataFrame([("p2", "S1"), ("q", "S1"), ("q2", "W1")], "zone_id string, area_id string")
    assert {x["zone_id"]: x["forecast_id"] for x in forecast.forecast_of(z, f).collect()} == {"p2": "north", "q": "south"}
    s = spark.createDataFrame([("north", 0, "SE", ["tln", "alp"]), ("north", 1, "SE", ["tln"]), ("north", 2, "W", ["alp"]), ("north", 3, None, ["alp"])], "forecast_id string, k int, dominant_aspect string, bands array<string>")
    p = spark.createDataFrame([("north", "wind", ["e_tln", "se_alp"])], "forecast_id string, type string, codes array<string>")
    assert [x["listed_here"] for x in forecast.problems_here(s, p).orderBy("k").collect()] == [True, False, False, None]
    low, high = 2200, 2900
    heights = [(1, 2300.0, 2700.0), (2, 1500.0, 2250.0), (3, 2950.0, 3100.0), (4, None, None)]
    got = {x["k"]: x["bands"] for x in forecast.with_bands(spark.createDataFrame(heights, "k int, min_elevation double, max_elevation double"), low, high).collect()}
    assert got == {1: ["tln"], 2: ["btl", "tln"], 3: ["alp"], 4: ["btl", "tln", "alp"]}


def test_null_in_null_out(spark):
    d = spark.createDataFrame([(None, None), (350.0, 3), (170.0, 9)], "az double, k int")
    got = [tuple(r) for r in d.select(S.aspect_sector(F.col("az")), S.class_name(F.col("k")), S.danger_name(F.col("k"))).collect()]
    assert got == [(None, None, None), ("N", "Complex", "3 - Considerable"), ("S", None, None)]
    assert d.select(S.saturating(F.lit(float("nan"))), S.saturating(F.lit(1e9)), S.saturating(F.lit(-2.9))).first()[:] == (0, 32767, -2)


def test_model():
    for lon, lat in ((11.4, 47.3), (-70.2, -33.1), (-179.9, 0.5), (179.9, 61.0), (0.0, -0.1)):
        assert model.utm_epsg(lon, lat) == (32600 if lat >= 0 else 32700) + int((lon + 180) // 6) + 1
    assert model.utm_epsg(180, -5) == 32760  # the last zone holds its eastern edge
    assert model.degree_tiles(model.BBox.of(6.2, 45.4, 7.9, 46.3)) == ["n47e006", "n47e007", "n46e006", "n46e007"]
    assert model.degree_tiles(model.BBox.of(10, 50, 11, 51)) == ["n51e010"]
    assert [model.fnv1a64_hex(x) for x in (b"", b"a", b"foobar")] == ["cbf29ce484222325", "af63dc4c8601ec8c", "85944171f73967e8"]  # published vectors of the hash
    w = model.snapped_window(model.BBox(1, 1, 25, 19), 10)
    assert (w.rows, w.cols, w.x0, w.y0) == (2, 3, 0, 20)
    with pytest.raises(ValueError):
        model.snapped_window(model.BBox(0, 0, 1e6, 1e6), 1)
    assert META.cell_at(440, 900) is None and META.cell_at(200, 960) == (0, 0) and META.cell_at(439.9, 800.1) == (7, 11) and META.trimmed(2).rows == 4
    assert "size=10%2C10" in model.export_url("http://x", model.BBox(0, 0, 1, 1), 10, 10, 32613)
    with pytest.raises(ValueError):
        model.check_aligned([META, META.trimmed(1)])


def test_config():
    c = config.Config('schema_version = 1\n[prep]\npad_m = 500\n[regions.a]\ndescription = "x"\n[regions.a.classify]\ntree1 = 20\ntree2 = 55\ntree3 = 75\n')
    assert c.params("a").classify.tree1 == 20 and c.params().classify.tree1 == 10 and c.params().pad_m() == 500 and c.region_names() == ["a"]
    for bad in ("schema_version = 2", "schema_version = 1\nodd = 1", "schema_version = 1\n[classify]\nwin_size = 2", "schema_version = 1\n[classify]\nnope = 2"):
        with pytest.raises(ValueError):
            config.Config(bad)
    with pytest.raises(ValueError):
        config.Params().pad_m()


def test_tiles(spark):
    """Ids of a zoom are a curve: all different, dense, neighbours side by side; zooms follow one another."""
    first = 0
    for z in range(5):
        at = {tiles.hilbert(z, x, y): (x, y) for x in range(1 << z) for y in range(1 << z)}
        assert sorted(at) == list(range(first, first + 4**z))
        assert all(sum(abs(a - b) for a, b in zip(at[k], at[k + 1])) == 1 for k in list(at)[:0] + sorted(at)[:-1])
        first += 4**z
    r = random.Random(6)
    content = {(z, x, y): r.choice((b"sea", b"rock and ice", b"")) or b"x" * (x + 1) for z in (2, 3) for x in range(1 << z) for y in range(1 << z)}
    t = spark.createDataFrame([(*k, v) for k, v in content.items()], "z int, x int, y int, body binary")
    a = tiles.write_pmtiles(t, "body", (5, 45, 8, 47), {"n": 1})
    ids = sorted((tiles.hilbert(*k), v) for k, v in content.items())
    entries = 1 + sum(i != j + 1 or v != w for (j, w), (i, v) in zip(ids, ids[1:]))
    assert a[:8] == b"PMTiles\x03" and [int.from_bytes(a[72 + 8 * k : 80 + 8 * k], "little") for k in range(3)] == [len(content), entries, len(set(content.values()))]
    assert all(tiles.read_tile(a, *k) == v for k, v in content.items()) and tiles.read_tile(a, 4, 0, 0) is None
    with pytest.raises(ValueError):
        tiles.directory(t.union(t), "body")


def test_render(spark):
    lon0, lat = -105.0, 40.5
    e, n = spark.range(1).select(*S.utm_forward(F.lit(-105.9), F.lit(lat), F.lit(lon0))).first()
    m = model.GridMeta(e, n, 10, 10, 8, 12, 32613)
    out = tiles.render(cells(spark), "exposure", m, (-105.9, lat - 0.001, -105.898, lat), [14], lon0).collect()
    assert out and all(bytes(r["png"]).startswith(b"\x89PNG") for r in out)


def test_api(spark):
    far = model.GridMeta(5000, 960, 20, 20, 8, 12)
    r = [api.Region("west", cells(spark), META, model.BBox(200, 800, 440, 960)), api.Region("east", cells(spark), far, model.BBox(5000, 800, 5240, 960))]
    assert api.point(r, 210, 950)["class_name"] == "Non-avalanche" and api.point(r, 5100, 810, "east")["region"] == "east"
    hist = next(x for x in api.regions(r)["regions"] if x["name"] == "west")["classes"]
    count = [sum((k // 12 + k % 12) // 4 == c for k in range(96)) for c in range(5)]
    assert [hist[k] for k in ("Non-avalanche", "Simple", "Challenging", "Complex", "Extreme")] == count
    assert api.route(r, line(spark, (210, 950), (290, 950)))["summary"]["class1_m"] == pytest.approx(10)
    # the first vertex is in no region, another one is
    assert api.route(r, line(spark, (2000, 900), (5010, 900)))["region"] == "east"
    square = [(4990, 850), (5050, 850), (5050, 900), (4990, 900)]
    e = spark.createDataFrame([(0, 0, i, *map(float, square[i]), *map(float, square[(i + 1) % 4])) for i in range(4)], "poly_id long, ring int, seq int, x1 double, y1 double, x2 double, y2 double")
    assert api.area(r, e)["region"] == "east"
    for f, status in ((lambda: api.point(r, float("inf"), 0), 400), (lambda: api.point(r, 210, 950, "north"), 404), (lambda: api.point(r, 2000, 900), 404), (lambda: api.area(r, e.limit(0)), 400)):
        with pytest.raises(api.ApiError) as x:
            f()
        assert x.value.status == status and "disclaimer" in x.value.body


def test_grid_store(spark, tmp_path):
    grids.write_grid(cells(spark), str(tmp_path / "g"), META, {"tool": "test"}, tile=4)
    back, meta = grids.read_grid(spark, str(tmp_path / "g"))
    assert meta == META and back.count() == 96
    assert grids.read_window(spark, str(tmp_path / "g"), 3, 5, 2, 9, tile=4).count() == 3 * 8
    assert {x["band"]: x["value"] for x in grids.sample_bands(back, 1, 9).collect()} == {"exposure": 2.0, "dem": 1463.0}


def test_geographic_window(spark):
    src = model.GridMeta(-106.0, 41.0, 0.01, 0.01, 100, 100)
    dem = spark.range(10000).selectExpr("0L as grid_id", "cast(id div 100 as int) as row", "cast(id % 100 as int) as col", "cast(id % 100 as double) as dem")
    e, n = spark.range(1).select(*S.utm_forward(F.lit(-105.5), F.lit(40.5), F.lit(-105.0))).first()
    w = grids.geographic_window(dem, src, model.GridMeta(e, n, 100, 100, 3, 3), -105.0).where("row = 1 and col = 1").first()
    assert w["dem"] == pytest.approx(49.5 + 150 / 850, abs=0.05)


def test_stream(spark, tmp_path):
    p = spark.createDataFrame([(1, "2026-01-01 00:00:00", 210.0, 950.0), (1, "2026-01-01 00:01:00", 430.0, 810.0)], "user_id long, t string, x double, y double").selectExpr("user_id", "cast(t as timestamp) ts", "x", "y")
    p.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(p.schema).parquet(str(tmp_path / "in"))
    q = tracks.exposure(s, cells(spark), META).writeStream.outputMode("complete").format("memory").queryName("exposure").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["exposure"], r["positions"]) for r in spark.table("exposure").collect()} == {(0, 1), (4, 1)}


def test_queries_match_sql(spark):
    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name, sql in registry.oracle_sql().items():
        a, b = registry.queries()[name](spark, sf).toPandas(), con.execute(sql).df()
        cols = sorted(a.columns)
        assert cols == sorted(b.columns), name
        rows = lambda d: sorted(map(repr, d[cols].astype(object).where(d[cols].notna(), None).map(lambda v: float(v) if isinstance(v, (int, float)) else v).values.tolist()))  # noqa: B023, E731
        assert rows(a) == rows(b), name


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
