"""Named queries over the driver's tables and their equivalents in SQL.

The grid is derived from `part` (sources.grids.derived); doubles are rounded at the edge.
"""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import ClassifyParams, FlowParams, PraParams
from ..functions import scalars as S
from ..operators import classify as C
from ..operators import compare, focal, forecast, local, release, route, runout, tiles, zonal
from ..session import scratch_dir
from ..sources import files, grids
from . import terrain

P = ClassifyParams()
Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


def _grid(spark: SparkSession, sf: str):
    cells = grids.derived(spark, sf)
    return cells, grids.meta_of(cells)


def r4(c) -> F.Column:
    return F.round(F.col(c).cast("double") if isinstance(c, str) else c.cast("double"), 4)


G = """g AS (SELECT CAST(p_partkey // 50 AS INTEGER) AS row, CAST(p_partkey % 50 AS INTEGER) AS col,
 CAST(2000 + 4*abs(p_partkey // 50 - 20) + 3*abs(p_partkey % 50 - 25) + p_size AS DOUBLE) AS dem, CAST(p_partkey*37 % 101 AS INTEGER) AS forest,
 CAST(p_partkey*13 % 97 - 3 AS INTEGER) AS travel_angle, CAST(p_partkey*7 % 61 - 1 AS INTEGER) AS overhead,
 CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END AS pra, CAST(p_partkey*11 % 300 AS INTEGER) AS cell_count, CAST(p_partkey*17 % 270 AS DOUBLE) AS z_delta,
 CAST(p_partkey % 3 AS INTEGER) AS patch FROM part),
 d AS (SELECT max(row) + 1 AS nr, max(col) + 1 AS nc FROM g)"""
_NEAR = {"nw": (-1, -1), "n": (-1, 0), "ne": (-1, 1), "w": (0, -1), "e": (0, 1), "sw": (1, -1), "s": (1, 0), "se": (1, 1)}
N9 = (
    "n9 AS (SELECT g.*, g.dem AS c, " + ", ".join(f"{k}.dem AS {k}" for k in _NEAR) + " FROM g "
    + " ".join(f"LEFT JOIN g {k} ON {k}.row = g.row + {r} AND {k}.col = g.col + {c}" for k, (r, c) in _NEAR.items()) + ")"
)
HORN = """h AS (SELECT *, (ne+2*e+se)-(nw+2*w+sw) AS gx, (sw+2*s+se)-(nw+2*n+ne) AS gy FROM n9),
 sl AS (SELECT *, CAST(degrees(atan(sqrt(gx/10*(gx/10)+gy/10*(gy/10))/8)) AS FLOAT) AS slope,
  CASE WHEN gx=0 AND gy=0 THEN NULL ELSE CAST(degrees(atan2(gy,-gx)) AS FLOAT) END AS a0 FROM h),
 asp AS (SELECT *, CASE WHEN a0 IS NULL THEN NULL WHEN (CASE WHEN a0>90 THEN 450-a0 ELSE 90-a0 END)=360 THEN 0 WHEN a0>90 THEN 450-a0 ELSE 90-a0 END AS aspect FROM sl)"""
BASE = f"WITH {G}, {N9}, {HORN}"
SMOOTH = """si AS (SELECT row, col, CASE WHEN slope IS NULL THEN -9999 ELSE CAST(trunc(slope) AS INTEGER) END AS s FROM sl),
 p1 AS (SELECT a.row, a.col, CAST(sum(greatest(b.s,0)) // 3 AS INTEGER) AS v FROM si a, d, (VALUES (-1),(0),(1)) o(k), si b
  WHERE b.col=a.col AND b.row=greatest(0,least(nr-1,a.row+k)) GROUP BY 1,2),
 p2 AS (SELECT a.row, a.col, CAST(sum(b.v) // 3 AS INTEGER) AS sm FROM p1 a, d, (VALUES (-1),(0),(1)) o(k), p1 b
  WHERE b.row=a.row AND b.col=greatest(0,least(nc-1,a.col+k)) GROUP BY 1,2),
 k0 AS (SELECT si.row, si.col, s, sm, CASE WHEN s>0 AND s<=15 THEN 0 ELSE s END v0 FROM si JOIN p2 USING (row, col)),
 k1 AS (SELECT *, CASE WHEN v0>15 AND v0<=18 THEN 1 ELSE v0 END v1 FROM k0), k2 AS (SELECT *, CASE WHEN v1>18 AND v1<=28 THEN 2 ELSE v1 END v2 FROM k1),
 k3 AS (SELECT *, CASE WHEN v2>28 AND v2<=100 THEN 3 ELSE v2 END v3 FROM k2),
 cl AS (SELECT row, col, s AS slope_int, sm AS slope_smooth, CASE WHEN sm>39 AND sm<=100 THEN 4 ELSE v3 END AS slope_class FROM k3)"""
CODES = """cd AS (SELECT row, col, greatest(CASE WHEN travel_angle>=0 AND travel_angle<90 THEN 1 ELSE travel_angle END,
  CASE WHEN travel_angle<24 THEN 0 WHEN travel_angle<90 THEN 2 ELSE travel_angle END, CASE WHEN travel_angle<33 THEN 0 WHEN travel_angle<90 THEN 3 ELSE travel_angle END) AS runout_class,
  CASE WHEN overhead=-9999 THEN 1 WHEN overhead>=0 AND overhead<=5 THEN 1 WHEN overhead>5 AND overhead<=40 THEN 2 WHEN overhead>40 AND overhead<=20000 THEN 3 ELSE overhead END AS count_class,
  CASE WHEN forest<=10 THEN 10 WHEN forest<=50 THEN 20 WHEN forest<65 THEN 30 ELSE 40 END AS forest_code, CASE WHEN pra=1 THEN 100 ELSE pra END AS release_code FROM g)"""
LOOK = "lk AS (SELECT * FROM (VALUES " + ", ".join(f"({m + f + r}, {c})" for (r, f), cs in local.LOOKUP.items() for m, c in enumerate(cs)) + ") t(key, class))"
MERGED = f"""{BASE}, {SMOOTH}, {CODES}, {LOOK}, mg AS (SELECT cl.row, cl.col, slope_class, runout_class, count_class, forest_code, release_code,
 greatest(slope_class, runout_class, count_class) AS merge_max FROM cl JOIN cd USING (row, col)),
 ma AS (SELECT mg.*, CAST(greatest(coalesce(class, merge_max+forest_code+release_code), 0) AS INTEGER) AS merge_all FROM mg LEFT JOIN lk ON key = merge_max+forest_code+release_code)"""


@query(f"{BASE}, {SMOOTH} SELECT slope_class AS class, count(*) AS cells FROM cl GROUP BY 1")
def terrain_histogram(spark: SparkSession, sf: str) -> DataFrame:
    cells, m = _grid(spark, sf)
    d = focal.horn_slope(cells, "dem", m.dx, m.dy, m.rows, m.cols)
    return compare.class_histogram(local.slope_classes(d, "slope", P, m.rows, m.cols), "slope_class")


flagship = terrain_histogram


@query(f"{BASE} SELECT row, col, round(CAST(slope AS DOUBLE), 4) AS slope, round(CAST(aspect AS DOUBLE), 4) AS aspect FROM asp")
def horn_slope_aspect(spark, sf):
    cells, m = _grid(spark, sf)
    return focal.terrain(cells, "dem", m.dx, m.dy, m.rows, m.cols).select("row", "col", r4("slope").alias("slope"), r4("aspect").alias("aspect"))


_PAD = """WITH {G}, x0 AS (SELECT row, col, dem FROM g UNION ALL SELECT -1, a.col, 2*a.dem-b.dem FROM g a JOIN g b ON a.row=0 AND b.row=1 AND a.col=b.col
 UNION ALL SELECT nr, a.col, 2*a.dem-b.dem FROM d, g a JOIN g b ON a.col=b.col WHERE a.row=nr-1 AND b.row=nr-2),
 x1 AS (SELECT * FROM x0 UNION ALL SELECT a.row, -1, CASE WHEN a.row=-1 OR a.row=nr THEN a.dem ELSE 2*a.dem-b.dem END FROM d, x0 a JOIN x0 b ON a.row=b.row AND a.col=0 AND b.col=1
 UNION ALL SELECT a.row, nc, CASE WHEN a.row=-1 OR a.row=nr THEN a.dem ELSE 2*a.dem-b.dem END FROM d, x0 a JOIN x0 b ON a.row=b.row WHERE a.col=nc-1 AND b.col=nc-2)"""


@query(
    _PAD.format(G=G) + ", n9 AS (SELECT g.row, g.col, " + ", ".join(f"{k}.dem AS {k}" for k in _NEAR) + " FROM g "
    + " ".join(f"JOIN x1 {k} ON {k}.row = g.row + {r} AND {k}.col = g.col + {c}" for k, (r, c) in _NEAR.items())
    + ") SELECT row, col, round(CAST(CAST(degrees(atan(sqrt(pow(((ne+2*e+se)-(nw+2*w+sw))/10,2)+pow(((sw+2*s+se)-(nw+2*n+ne))/10,2))/8)) AS FLOAT) AS DOUBLE), 4) AS slope FROM n9"
)
def horn_slope_edges(spark, sf):
    cells, m = _grid(spark, sf)
    return focal.horn_slope(cells, "dem", m.dx, m.dy, m.rows, m.cols, True).select("row", "col", r4("slope").alias("slope"))


@query(f"{BASE}, {SMOOTH} SELECT row, col, slope_int, slope_smooth, slope_class FROM cl")
def slope_classes(spark, sf):
    cells, m = _grid(spark, sf)
    d = focal.horn_slope(cells, "dem", m.dx, m.dy, m.rows, m.cols)
    return local.slope_classes(d, "slope", P, m.rows, m.cols).select("row", "col", "slope_int", "slope_smooth", "slope_class")


@query(f"""WITH {G}, w AS (SELECT row, col, dem, lag(dem) OVER (PARTITION BY col ORDER BY row) u, lead(dem) OVER (PARTITION BY col ORDER BY row) v,
 lag(dem) OVER (PARTITION BY row ORDER BY col) l, lead(dem) OVER (PARTITION BY row ORDER BY col) r FROM g),
 p AS (SELECT row, col, CASE WHEN u IS NULL THEN (v-dem)/10 WHEN v IS NULL THEN (dem-u)/10 ELSE (v-u)/20 END px, CASE WHEN l IS NULL THEN (r-dem)/10 WHEN r IS NULL THEN (dem-l)/10 ELSE (r-l)/20 END py FROM w)
 SELECT row, col, round(CAST(CAST(atan(sqrt(px*px+py*py))*180/pi() AS FLOAT) AS DOUBLE), 4) AS slope FROM p""")
def gradient_slope(spark, sf):
    cells, m = _grid(spark, sf)
    return focal.gradient_slope(cells, "dem", m.dx).select("row", "col", r4("slope").alias("slope"))


@query(f"""WITH {G}, o AS (SELECT a.k AS r, b.k AS c FROM (VALUES (-2),(-1),(0),(1),(2)) a(k), (VALUES (-2),(-1),(0),(1),(2)) b(k) WHERE a.k*a.k+b.k*b.k BETWEEN 1 AND 4),
 w AS (SELECT g.row, g.col, quantile_cont(atan((n.dem-g.dem)/(sqrt(r*r+c*c)*10)), 0.5) q FROM g, d, o, g n WHERE n.row=g.row+r AND n.col=g.col+c AND g.row BETWEEN 2 AND nr-3 AND g.col BETWEEN 2 AND nc-3 GROUP BY 1,2)
 SELECT g.row, g.col, round(CAST(CAST(q AS FLOAT) AS DOUBLE), 4) AS windshelter FROM g LEFT JOIN w USING (row, col)""")
def windshelter(spark, sf):
    cells, m = _grid(spark, sf)
    return focal.windshelter(cells, "dem", m.dx, 2, m.rows, m.cols).select("row", "col", r4("windshelter").alias("windshelter"))


@query(f"WITH {G}, {CODES} SELECT row, col, CAST(runout_class AS INTEGER) runout_class, CAST(count_class AS INTEGER) count_class, CAST(forest_code AS INTEGER) forest_code, CAST(release_code AS INTEGER) release_code FROM cd")
def rule_codes(spark, sf):
    cells, _ = _grid(spark, sf)
    t = local.truncated
    return cells.select("row", "col", local.runout_class(t(F.col("travel_angle")), P).alias("runout_class"), local.count_class(t(F.col("overhead")), P).alias("count_class"), local.forest_code(t(F.col("forest")), P).alias("forest_code"), local.release_code(t(F.col("pra"))).alias("release_code"))


def _merged(spark, sf):
    cells, m = _grid(spark, sf)
    return C.merged_classes(focal.horn_slope(cells, "dem", m.dx, m.dy, m.rows, m.cols), m, P), m


@query(f"{MERGED} SELECT row, col, CAST(merge_max AS INTEGER) AS merge_max, merge_all FROM ma")
def merged_lookup(spark, sf):
    return _merged(spark, sf)[0].select("row", "col", "merge_max", "merge_all")


@query(f"""WITH {G} SELECT row, col, round(1/(1+pow((dem-2100)/11,8)),5) AS slope_member, round(CASE WHEN 1/(1+pow((forest+15)/40.0,7))<=1e-5 THEN 1 ELSE 1/(1+pow((forest+15)/40.0,7)) END, 5) AS forest_member FROM g""")
def memberships(spark, sf):
    cells, _ = _grid(spark, sf)
    s, _, f = local.memberships(F.col("dem"), F.col("dem"), F.col("forest"), PraParams(slope=(11, 4, 2100)))
    return cells.select("row", "col", F.round(s, 5).alias("slope_member"), F.round(f, 5).alias("forest_member"))


@query(f"""WITH {G}, t AS (SELECT row, col, (forest/101.0)::DOUBLE s, ((forest*7)%101/101.0)::DOUBLE w, ((forest*3)%101/101.0)::DOUBLE f FROM g),
 p AS (SELECT *, round_even(((1-least(s,w,f))*least(s,w,f)+least(s,w,f)*(s+w+f)/3)*100000,0)/100000*100 AS x FROM t)
 SELECT row, col, CAST(trunc(x) AS INTEGER) AS continuous, CAST(CASE WHEN x>=0 AND x<15 THEN 0 WHEN x>15 AND x<=100 THEN 1 ELSE trunc(x) END AS INTEGER) AS "binary" FROM p""")
def fuzzy_release(spark, sf):
    cells, _ = _grid(spark, sf)
    v = [(F.col("forest") * k % 101).cast("double") / 101 for k in (1, 7, 3)]
    whole, binary = local.fuzzy(*v, 0.15)
    return cells.select("row", "col", whole.alias("continuous"), binary.alias("binary"))


@query(f"WITH {G}, m AS (SELECT max(cell_count) AS t FROM g) SELECT row, col, CAST(trunc((CASE WHEN cell_count>0 AND t>1 THEN ln(cell_count)/ln(t)*100 ELSE 0 END + z_delta/270*100)/2) AS INTEGER) AS overhead FROM g, m")
def overhead(spark, sf):
    cells, _ = _grid(spark, sf)
    return C.with_overhead(cells.drop("overhead"), 270).select("row", "col", "overhead")


_REACH = """e AS (SELECT a.row*{w}+a.col AS p, b.row*{w}+b.col AS q FROM {t} a JOIN {t} b ON a.{v}=b.{v} AND abs(a.row-b.row)<=1 AND abs(a.col-b.col)<=1 WHERE NOT (a.row=b.row AND a.col=b.col) {also}),
 walk(p, root) AS (SELECT row*{w}+col, row*{w}+col FROM {t} WHERE true {alone} UNION SELECT e.q, walk.root FROM walk JOIN e ON e.p=walk.p WHERE walk.root < e.q),
 comp AS (SELECT p, min(root) AS root FROM walk GROUP BY 1)"""
BLOCK = "pt AS (SELECT row, col, CASE WHEN (row//3*7 + col//4*5) % 6 < 2 THEN 0 ELSE (row//3*7 + col//4*5) % 6 END AS v FROM g)"


@query(f"WITH RECURSIVE {G}, {BLOCK}, " + _REACH.format(w=50, t="pt", v="v", also="AND a.v<>0", alone="AND v<>0") + ", n AS (SELECT root, dense_rank() OVER (ORDER BY root) AS label FROM (SELECT DISTINCT root FROM comp)) SELECT pt.row, pt.col, CAST(coalesce(label, 0) AS INTEGER) AS label FROM pt LEFT JOIN comp ON p=row*50+col LEFT JOIN n USING (root)")
def label_components(spark, sf):
    cells, m = _grid(spark, sf)
    return zonal.numbered(zonal.label(_blocks(cells), "v", m.cols, tile=16)).select("row", "col", "label")


def _blocks(cells):
    v = F.expr("(row div 3 * 7 + col div 4 * 5) % 6")
    return cells.select("grid_id", "row", "col", F.when(v < 2, 0).otherwise(v).cast("int").alias("v"))


@query(f"WITH RECURSIVE {G}, {BLOCK}, " + _REACH.format(w=50, t="pt", v="v", also="AND a.v<>0", alone="AND v<>0") + ", s AS (SELECT root, count(*) AS c FROM comp GROUP BY 1) SELECT pt.row, pt.col, coalesce(c >= 13, false) AS keep FROM pt LEFT JOIN comp ON p=row*50+col LEFT JOIN s USING (root)")
def cluster_mask(spark, sf):
    cells, m = _grid(spark, sf)
    return zonal.cluster_mask(zonal.numbered(zonal.label(_blocks(cells), "v", m.cols, tile=16)), 13).select("row", "col", "keep")


#: The sieve over comp and {t}(row, col, {v}): chains of largest neighbours, each up to its first large component.
_SIEVE = """sz AS (SELECT root, count(*) AS size, any_value({v}) AS val FROM comp JOIN {t} ON p = row*{w}+col GROUP BY 1),
 near AS (SELECT ca.root AS a, cb.root AS b, min((x.row*{w}+x.col)*4+k) AS rank FROM {t} x, (VALUES (-1,0,0),(-1,-1,1),(-1,1,2),(0,-1,3)) o(dr, dc, k), {t} y, comp ca, comp cb
  WHERE y.row=x.row+dr AND y.col=x.col+dc AND ca.p=x.row*{w}+x.col AND cb.p=y.row*{w}+y.col AND ca.root<>cb.root GROUP BY 1, 2),
 touch AS (SELECT a, b, min(rank) AS rank FROM (SELECT a, b, rank FROM near UNION ALL SELECT b, a, rank FROM near) GROUP BY 1, 2),
 big AS (SELECT a, b FROM touch JOIN sz ON root=b QUALIFY row_number() OVER (PARTITION BY a ORDER BY size DESC, rank)=1),
 chain(a, b) AS (SELECT root, root FROM sz UNION SELECT chain.a, big.b FROM chain JOIN sz ON root=chain.b JOIN big ON big.a=chain.b WHERE size<{n}),
 fin AS (SELECT chain.a AS root, any_value(val) AS val FROM chain JOIN sz ON root=b WHERE size>={n} GROUP BY 1),
 sv AS (SELECT row, col, CAST(coalesce(fin.val, {v}) AS INTEGER) AS sieved FROM {t} LEFT JOIN comp ON p=row*{w}+col LEFT JOIN fin USING (root))"""


@query(f"WITH RECURSIVE {G}, {BLOCK}, " + _REACH.format(w=50, t="pt", v="v", also="", alone="") + ", " + _SIEVE.format(w=50, t="pt", v="v", n=9) + " SELECT pt.row, pt.col, v, sieved FROM pt JOIN sv USING (row, col)")
def sieve(spark, sf):
    cells, m = _grid(spark, sf)
    return zonal.sieve(_blocks(cells), "v", m.cols, 9).select("row", "col", "v", "sieved")


@query(f"""WITH {G}, b AS (SELECT n_nationkey AS k, CAST(n_nationkey % 5 * 90 + 3 AS DOUBLE) AS x0, CAST(n_nationkey // 5 * 70 + 4 AS DOUBLE) AS y0 FROM nation),
 h AS (SELECT DISTINCT g.row, g.col, patch FROM g, d, b WHERE (col+0.5)*10 > x0 AND (col+0.5)*10 < x0+61 AND nr*10-(row+0.5)*10 > y0 AND nr*10-(row+0.5)*10 < y0+52)
 SELECT patch AS class, count(*) AS cells, CAST(count(*)*100 AS DOUBLE) AS area_m2 FROM h GROUP BY 1""")
def class_areas(spark, sf):
    cells, m = _grid(spark, sf)
    n = spark.read.parquet(f"{sf}/nation.parquet").select("n_nationkey")
    x0, y0 = (F.col("n_nationkey") % 5 * 90 + 3).cast("double"), F.expr("n_nationkey div 5 * 70 + 4").cast("double")
    pts = F.array(*[F.struct((x0 + a).alias("x"), (y0 + b).alias("y")) for a, b in ((0, 0), (61, 0), (61, 52), (0, 52))])
    e = n.select(F.col("n_nationkey").alias("poly_id"), F.lit(0).alias("ring"), pts.alias("p")).select("poly_id", "ring", "p", F.posexplode("p").alias("seq", "a"))
    b = F.get("p", (F.col("seq") + 1) % 4)
    e = e.select("poly_id", "ring", "seq", F.col("a.x").alias("x1"), F.col("a.y").alias("y1"), b["x"].alias("x2"), b["y"].alias("y2"))
    return zonal.class_areas(cells, e, "patch", m)


@query(f"WITH {G} SELECT CAST(row-least(3,(nr-1)//2) AS INTEGER) AS row, CAST(col-3 AS INTEGER) AS col, dem FROM g, d WHERE row BETWEEN least(3,(nr-1)//2) AND nr-1-least(3,(nr-1)//2) AND col BETWEEN 3 AND nc-4")
def trim(spark, sf):
    cells, m = _grid(spark, sf)
    return zonal.trim(cells, 3, m.rows, m.cols).select("row", "col", "dem")


@query(f"WITH {G} SELECT count(*) FILTER (WHERE f IS NOT NULL AND t IS NOT NULL) AS compared, count(*) FILTER (WHERE (f IS NULL) <> (t IS NULL)) AS mismatched, max(least(abs(f-t), 360-abs(f-t))) AS max_diff, round(avg(least(abs(f-t), 360-abs(f-t))), 4) AS mean_diff FROM (SELECT CASE WHEN forest > 90 THEN NULL ELSE CAST(forest*3 AS DOUBLE) END AS f, CASE WHEN travel_angle < 0 THEN NULL ELSE CAST(travel_angle AS DOUBLE) END AS t FROM g)")
def agreement(spark, sf):
    cells, _ = _grid(spark, sf)
    a = cells.select("grid_id", "row", "col", F.when(F.col("forest") <= 90, (F.col("forest") * 3).cast("double")).alias("v"))
    b = cells.select("grid_id", "row", "col", F.when(F.col("travel_angle") >= 0, F.col("travel_angle").cast("double")).alias("v"))
    return compare.agreement(a, b, "v", True).withColumn("mean_diff", F.round("mean_diff", 4))


ROUTES = """v AS (SELECT user_id, CAST(event_id*7919 % 520 AS DOUBLE) AS x, CAST(event_id*104729 % 420 AS DOUBLE) AS y, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)-1 AS seq FROM events),
 sg AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM v WINDOW w AS (PARTITION BY user_id ORDER BY seq)),
 ln AS (SELECT *, sqrt((x2-x)*(x2-x)+(y2-y)*(y2-y)) AS len FROM sg), ln2 AS (SELECT *, greatest(1, CAST(ceil(len/5) AS INTEGER)) AS n FROM ln WHERE len > 0),
 pc AS (SELECT user_id AS route_id, seq, i AS piece, x+(i+0.5::DOUBLE)/n*(x2-x) AS px, y+(i+0.5::DOUBLE)/n*(y2-y) AS py, len/n AS length FROM ln2, unnest(range(n)) AS u(i)),
 sp AS (SELECT pc.*, g.patch, g.dem, g.pra, (floor((nr*10-py)/10) NOT BETWEEN 0 AND nr-1 OR floor(px/10) NOT BETWEEN 0 AND nc-1) AS outside FROM pc CROSS JOIN d LEFT JOIN g ON g.row = floor((nr*10-py)/10) AND g.col = floor(px/10)),
 nw AS (SELECT *, CASE WHEN lag(coalesce(patch,-1)) OVER w = coalesce(patch,-1) AND lag(outside) OVER w = outside THEN 0 ELSE 1 END AS nw FROM sp WINDOW w AS (PARTITION BY route_id ORDER BY seq, piece)),
 st AS (SELECT *, sum(nw) OVER (PARTITION BY route_id ORDER BY seq, piece) AS stretch FROM nw)"""


def _stretches(spark, sf):
    cells, m = _grid(spark, sf)
    layers = cells.select("grid_id", "row", "col", F.col("patch").alias("exposure"), "dem", "pra")
    return route.evaluate(grids.routes(spark, sf), layers, m)


@query(f"WITH {G}, {ROUTES} SELECT route_id, CAST(stretch AS BIGINT) AS stretch, min(patch) AS class, bool_and(outside) AS outside, round(sum(length),3) AS length, min(dem) AS min_elevation, max(dem) AS max_elevation, round(sum(CASE WHEN pra=1 THEN length ELSE 0 END),3) AS release_m FROM st GROUP BY 1,2")
def route_stretches(spark, sf):
    return _stretches(spark, sf).select("route_id", "stretch", "class", "outside", F.round("length", 3).alias("length"), "min_elevation", "max_elevation", F.round("release_m", 3).alias("release_m"))


@query(f"WITH {G}, {ROUTES} SELECT route_id, round(sum(length),3) AS total_m, round(sum(CASE WHEN patch=0 THEN length ELSE 0 END),3) AS class0_m, round(sum(CASE WHEN patch=2 THEN length ELSE 0 END),3) AS class2_m, round(sum(CASE WHEN outside THEN length ELSE 0 END),3) AS outside_m, max(patch) AS max_class FROM st GROUP BY 1")
def route_totals(spark, sf):
    t = route.totals(_stretches(spark, sf))
    return t.select("route_id", *[F.round(c, 3).alias(c) for c in ("total_m", "class0_m", "class2_m", "outside_m")], "max_class")


@query("SELECT c_custkey, CAST(CASE WHEN lat>=0 THEN 32600 ELSE 32700 END + least(60, floor((lon+180)/6)+1) AS INTEGER) AS epsg, CAST(greatest(0, least(1023, floor((lon+180)/360*1024))) AS INTEGER) AS tile_x, CAST(greatest(0, least(1023, floor((1-ln(tan(radians(lat))+1/cos(radians(lat)))/pi())/2*1024))) AS INTEGER) AS tile_y FROM (SELECT c_custkey, CAST(c_custkey*7919 % 360 - 180 AS DOUBLE)+0.37 AS lon, CAST(c_custkey*104729 % 160 - 80 AS DOUBLE)+0.21 AS lat FROM customer)")
def zones_and_tiles(spark, sf):
    c = _places(spark, sf)
    return c.select("c_custkey", S.utm_epsg(F.col("lon"), F.col("lat")).alias("epsg"), S.tile_x(F.col("lon"), 10).alias("tile_x"), S.tile_y(F.col("lat"), 10).alias("tile_y"))


def _places(spark, sf):
    k = F.col("c_custkey")
    return spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", ((k * 7919 % 360 - 180).cast("double") + 0.37).alias("lon"), ((k * 104729 % 160 - 80).cast("double") + 0.21).alias("lat"))


@query("SELECT c_custkey, round(lon, 6) AS lon, round(lat, 6) AS lat FROM (SELECT c_custkey, CAST(c_custkey*7919 % 360 - 180 AS DOUBLE)+0.37 AS lon, CAST(c_custkey*104729 % 160 - 80 AS DOUBLE)+0.21 AS lat FROM customer)")
def utm_round_trip(spark, sf):
    c = _places(spark, sf).withColumn("lon0", F.least(F.lit(60), F.floor((F.col("lon") + 180) / 6) + 1) * 6 - 183)
    x, y = S.utm_forward(F.col("lon"), F.col("lat"), F.col("lon0"))
    c = c.withColumns({"x": x, "y": y})
    lon, lat = S.utm_inverse(F.col("x"), F.col("y"), F.col("lon0"))
    return c.select("c_custkey", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


_STEP = "SELECT k, s//2, CASE WHEN ry=0 AND rx=1 THEN s-1-y WHEN ry=0 THEN y ELSE x END, CASE WHEN ry=0 AND rx=1 THEN s-1-x WHEN ry=0 THEN x ELSE y END, d+s*s*xor(3*rx, ry) FROM (SELECT *, CASE WHEN (x & s)>0 THEN 1 ELSE 0 END AS rx, CASE WHEN (y & s)>0 THEN 1 ELSE 0 END AS ry FROM w WHERE s>0)"


@query(f"WITH RECURSIVE w(k, s, x, y, d) AS (SELECT c_custkey, 512::BIGINT, CAST(c_custkey*7919 % 1024 AS BIGINT), CAST(c_custkey*104729 % 1024 AS BIGINT), 0::BIGINT FROM customer UNION ALL {_STEP}) SELECT k AS c_custkey, d + 349525 AS tile_id FROM w WHERE s = 0")
def hilbert_tile_id(spark, sf):
    k = F.col("c_custkey")
    return spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", S.tile_id(F.lit(10), k * 7919 % 1024, k * 104729 % 1024).alias("tile_id"))


@query("WITH s AS (SELECT event_id, ['Low','2','considerable','4 - High','EXTREME!','no rating','', 'odd'][1 + event_id % 8] AS r, ['n_alp','tln-SW','mystery','btl','E btl','alp_e_x'][1 + event_id % 6] AS c FROM events) SELECT event_id, CAST(CASE lower(regexp_replace(r, '[^0-9A-Za-z]', '', 'g')) WHEN 'low' THEN 1 WHEN '2' THEN 2 WHEN 'considerable' THEN 3 WHEN 'extreme' THEN 5 END AS INTEGER) AS level, CASE c WHEN 'n_alp' THEN 'N/alp' WHEN 'tln-SW' THEN 'SW/tln' WHEN 'E btl' THEN 'E/btl' END AS place FROM s")
def danger_and_location(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id")
    word = lambda xs: F.get(F.array(*map(F.lit, xs)), (F.col("event_id") % len(xs)).cast("int"))
    r, c = word(["Low", "2", "considerable", "4 - High", "EXTREME!", "no rating", "", "odd"]), word(["n_alp", "tln-SW", "mystery", "btl", "E btl", "alp_e_x"])
    at = S.decode_location(c)
    return e.select("event_id", S.danger_level(r).alias("level"), F.concat_ws("/", at["aspect"], at["band"]).alias("place")).withColumn("place", F.when(F.col("place") != "", F.col("place")))


@query("SELECT event_id, CAST(floor(epoch(CAST(ts AS TIMESTAMP))) AS BIGINT) AS zoned, CAST(NULL AS BIGINT) AS zoneless FROM events")
def iso_epoch(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("s"))
    return e.select("event_id", S.epoch(F.concat("s", F.lit("Z"))).alias("zoned"), S.epoch(F.col("s")).alias("zoneless"))


@query("WITH z AS (SELECT n_nationkey AS k, CAST(n_nationkey % 5 * 100 AS DOUBLE) AS x0, CAST(n_nationkey // 5 * 80 AS DOUBLE) AS y0 FROM nation), p AS (SELECT event_id, CAST(event_id*7919 % 520 AS DOUBLE)+0.3 AS x, CAST(event_id*104729 % 420 AS DOUBLE)+0.3 AS y FROM events) SELECT event_id, CAST(k AS VARCHAR) AS zone_id FROM p JOIN z ON x>x0 AND x<x0+90 AND y>y0 AND y<y0+70 AND NOT (x>x0+30 AND x<x0+60 AND y>y0+20 AND y<y0+50)")
def zone_of_point(spark, sf):
    n = spark.read.parquet(f"{sf}/nation.parquet").select("n_nationkey")
    x0, y0 = (F.col("n_nationkey") % 5 * 100).cast("double"), F.expr("n_nationkey div 5 * 80").cast("double")
    ring = lambda a, b, c, d: F.array(*[F.struct((x0 + x).alias("x"), (y0 + y).alias("y")) for x, y in ((a, b), (c, b), (c, d), (a, d))])
    e = n.select(F.col("n_nationkey").cast("string").alias("zone_id"), F.lit(0).alias("poly_id"), F.posexplode(F.array(ring(0, 0, 90, 70), ring(30, 20, 60, 50))).alias("ring", "p"))
    e = e.select("zone_id", "poly_id", "ring", "p", F.posexplode("p").alias("seq", "a"))
    b = F.get("p", (F.col("seq") + 1) % 4)
    e = e.select("zone_id", "poly_id", "ring", F.col("a.x").alias("x1"), F.col("a.y").alias("y1"), b["x"].alias("x2"), b["y"].alias("y2"))
    k = F.col("event_id")
    p = spark.read.parquet(f"{sf}/events.parquet").select("event_id", ((k * 7919 % 520).cast("double") + 0.3).alias("x"), ((k * 104729 % 420).cast("double") + 0.3).alias("y"))
    return forecast.zone_of(p, e).select("event_id", "zone_id")


_GPX = "'<gpx><trk><trkseg>' || string_agg('<trkpt lat=\"' || (event_id % 90) || '.5\" lon=\"' || (event_id % 180) || '.25\"/>', '' ORDER BY event_id) || '</trkseg></trk></gpx>'"


@query("SELECT user_id AS route_id, CAST(0 AS BIGINT) AS part, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id)-1 AS INTEGER) AS seq, CAST(event_id % 180 AS DOUBLE)+0.25 AS lon, CAST(event_id % 90 AS DOUBLE)+0.5 AS lat FROM events")
def gpx_points(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_id")
    tag = F.format_string("<g:trkpt lat='%d.5' lon=\"%d.25\"/>", F.col("event_id") % 90, F.col("event_id") % 180)
    t = e.groupBy(F.col("user_id").alias("route_id")).agg(F.sort_array(F.collect_list(F.struct("event_id", tag.alias("t")))).alias("p"))
    t = t.select("route_id", F.concat(F.lit("<g:gpx><wpt lat='1' lon='2'/><g:trk><g:trkseg>"), F.array_join(F.transform("p", lambda x: x["t"]), ""), F.lit("</g:trkseg></g:trk></g:gpx>")).alias("value"))
    return files.gpx(t).select("route_id", F.col("part").cast("long").alias("part"), "seq", "lon", "lat")


@query("SELECT n_nationkey AS route_id, 0 AS ring, k AS seq, CAST(n_nationkey + (k+1)//2%2 AS DOUBLE) AS x1, CAST(k//2 AS DOUBLE) AS y1 FROM nation, (VALUES (0),(1),(2),(3)) t(k)")
def geojson_rings(spark, sf):
    n = F.col("n_nationkey")
    t = spark.read.parquet(f"{sf}/nation.parquet").select(n.cast("long").alias("route_id"), F.format_string('{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[[%d,0],[%d,0],[%d,1],[%d,1]]]}},{"type":"Feature","geometry":{"type":"Point","coordinates":[0,0]}}]}', n, n + 1, n + 1, n).alias("value"))
    return files.geojson_edges(t).select(F.col("route_id").cast("int").alias("route_id"), "ring", "seq", "x1", "y1")


@query("SELECT CAST(0 AS INTEGER) AS seq, 'f' || n_nationkey AS id, 'a' || (n_nationkey % 3) AS area_id, 0 AS day, CAST(1 + n_nationkey % 5 AS INTEGER) AS highest FROM nation")
def forecast_days(spark, sf):
    n = F.col("n_nationkey")
    t = spark.read.parquet(f"{sf}/nation.parquet").select(F.format_string('[{"type":"avalancheforecast","id":"f%d","areaId":"a%d","dangerRatings":{"days":[{"alp":"%d","tln":"Low","btl":"none"}]}},{"type":"other"}]', n, n % 3, 1 + n % 5).alias("value"))
    f = files.products(t)
    return f.join(forecast.days(f), "id").select("seq", "id", "area_id", "day", "highest")


@query(f"{MERGED} SELECT row, col, CASE WHEN merge_all BETWEEN 0 AND 4 THEN ['Non-avalanche','Simple','Challenging','Complex','Extreme'][merge_all+1] END AS class_name FROM ma")
def class_names(spark, sf):
    d, _ = _merged(spark, sf)
    return d.select("row", "col", F.when(F.col("merge_all").between(0, 4), S.class_name(F.col("merge_all"))).alias("class_name"))


@query(f"{MERGED.replace('WITH ', 'WITH RECURSIVE ', 1)}, sh AS (SELECT row, col, least(32767, merge_all + 1) AS v FROM ma), " + _REACH.format(w=50, t="sh", v="v", also="AND a.v<>0", alone="AND v<>0")
       + ", s AS (SELECT root, count(*) AS c FROM comp GROUP BY 1) SELECT sh.row, sh.col, merge_all, CAST(CASE WHEN c >= 15 THEN v - 1 END AS INTEGER) AS exposure FROM sh JOIN ma USING (row, col) LEFT JOIN comp ON p=sh.row*50+sh.col LEFT JOIN s USING (root)")
def classify_unfilled(spark, sf):
    """The classifier whose islands stay empty."""
    cells, m = _grid(spark, sf)
    d = focal.horn_slope(cells, "dem", m.dx, m.dy, m.rows, m.cols)
    return C.classify(d, m, ClassifyParams(isl_size_m2=1500), fill=None).select("row", "col", "merge_all", "exposure")


#: Gradient slope, wind shelter over 60 m, memberships and their fuzzy sum, in the defaults.
_PRA = f"""{G}, gw AS (SELECT row, col, dem, lag(dem) OVER (PARTITION BY col ORDER BY row) u, lead(dem) OVER (PARTITION BY col ORDER BY row) v,
  lag(dem) OVER (PARTITION BY row ORDER BY col) l, lead(dem) OVER (PARTITION BY row ORDER BY col) r FROM g),
 gp AS (SELECT row, col, CASE WHEN u IS NULL THEN (v-dem)/10 WHEN v IS NULL THEN (dem-u)/10 ELSE (v-u)/20 END px, CASE WHEN l IS NULL THEN (r-dem)/10 WHEN r IS NULL THEN (dem-l)/10 ELSE (r-l)/20 END py FROM gw),
 gs AS (SELECT row, col, CAST(atan(sqrt(px*px+py*py))*180/pi() AS FLOAT) AS slope FROM gp),
 o AS (SELECT a.k AS r, b.k AS c FROM range(-6, 7) a(k), range(-6, 7) b(k) WHERE a.k*a.k+b.k*b.k BETWEEN 1 AND 36),
 ws AS (SELECT g.row, g.col, CAST(quantile_cont(atan((n.dem-g.dem)/(sqrt(r*r+c*c)*10)), 0.5) AS FLOAT) AS ws FROM g, d, o, g n
  WHERE n.row=g.row+r AND n.col=g.col+c AND g.row BETWEEN 6 AND nr-7 AND g.col BETWEEN 6 AND nc-7 GROUP BY 1, 2),
 mb AS (SELECT row, col, ws, 1/(1+pow((slope::DOUBLE-43)/11.0::DOUBLE, 8)) AS s0, 1/(1+pow((coalesce(ws::DOUBLE, -9999)-3)/3.0::DOUBLE, 20)) AS w0, 1/(1+pow((forest::DOUBLE+15)/40.0::DOUBLE, 7)) AS f0 FROM gs JOIN g USING (row, col) LEFT JOIN ws USING (row, col)),
 md AS (SELECT row, col, ws, round_even(s0*100000, 0)/100000 AS s, round_even(w0*100000, 0)/100000 AS w, round_even(CASE WHEN f0<=1e-5 THEN 1 ELSE f0 END*100000, 0)/100000 AS f FROM mb),
 pf AS (SELECT *, round_even(((1-least(s,w,f))*least(s,w,f)+least(s,w,f)*(s+w+f)/3)*100000, 0)/100000*100 AS x FROM md),
 rb AS (SELECT row, col, ws, CAST(trunc(x) AS INTEGER) AS pra_continuous, CAST(CASE WHEN x>=0 AND x<15 THEN 0 WHEN x>15 AND x<=100 THEN 1 ELSE trunc(x) END AS INTEGER) AS v FROM pf)"""


@query(f"WITH RECURSIVE {_PRA}, " + _REACH.format(w=50, t="rb", v="v", also="", alone="") + ", " + _SIEVE.format(w=50, t="rb", v="v", n=4) + " SELECT rb.row, rb.col, round(ws::DOUBLE, 4) AS windshelter, pra_continuous, v AS pra_binary, sieved AS pra FROM rb JOIN sv USING (row, col)")
def release_areas(spark, sf):
    cells, m = _grid(spark, sf)
    d = release.release_areas(cells.drop("pra"), "dem", "forest", m, PraParams())
    return d.select("row", "col", r4("windshelter").alias("windshelter"), "pra_continuous", "pra_binary", "pra")


@query()
def flow_runout(spark, sf):
    cells, m = _grid(spark, sf)
    d = cells.select("grid_id", "row", "col", "dem", (F.col("forest") / 100).alias("wood"), F.col("pra").alias("start"))
    return runout.runout(d, "dem", "start", "wood", m, FlowParams()).select("row", "col", "cell_count", F.round("z_delta", 3).alias("z_delta"), F.round("flux", 5).alias("flux"), F.round("travel_angle", 3).alias("travel_angle"))


@query()
def classify(spark, sf):
    cells, m = _grid(spark, sf)
    d = focal.horn_slope(cells, "dem", m.dx, m.dy, m.rows, m.cols)
    return C.classify(d, m, ClassifyParams(isl_size_m2=1500)).select("row", "col", "merge_all", "exposure")


@query(f"""WITH RECURSIVE w(k, s, x, y, d) AS (SELECT c_custkey, 524288::BIGINT, CAST(c_custkey % 64 + 64*(c_custkey // 4096 % 16384) AS BIGINT), CAST(c_custkey % 4096 // 64 + 64*(c_custkey // 67108864) AS BIGINT), 0::BIGINT FROM customer UNION ALL {_STEP}),
 t AS (SELECT d + (pow(4, 20)::BIGINT - 1) // 3 AS id, k % 7 AS body FROM w WHERE s = 0), o AS (SELECT body, row_number() OVER (ORDER BY min(id)) - 1 AS place FROM t GROUP BY 1),
 n AS (SELECT *, CASE WHEN lag(body) OVER v = body AND lag(id) OVER v = id - 1 THEN 0 ELSE 1 END AS nw FROM t WINDOW v AS (ORDER BY id)),
 r AS (SELECT *, sum(nw) OVER (ORDER BY id) AS r FROM n)
 SELECT min(id) AS first_id, count(*) AS run, CAST(any_value(place) AS BIGINT) AS "offset", CAST(1 AS BIGINT) AS length FROM r JOIN o USING (body) GROUP BY r""")
def pmtiles_directory(spark, sf):
    """Every customer on a tile of zoom 20: squares of 4096 customers side by side, 16384 in a row."""
    k = F.col("c_custkey")
    x, y = F.expr("c_custkey % 64 + 64 * (c_custkey div 4096 % 16384)"), F.expr("c_custkey % 4096 div 64 + 64 * (c_custkey div 67108864)")
    t = spark.read.parquet(f"{sf}/customer.parquet").select(F.lit(20).alias("z"), x.cast("int").alias("x"), y.cast("int").alias("y"), (k % 7).cast("string").alias("body"))
    return tiles.directory(t, "body").select("first_id", "run", "offset", "length")


@query(f"WITH {G} SELECT row, col, CASE WHEN dem > 1800 AND slope > 30 AND slope < 35 THEN 1 ELSE 0 END AS start, round(CAST(greatest(0, least(1, forest/100.0)) AS DOUBLE), 6) AS fraction FROM (SELECT *, CAST(forest AS DOUBLE) AS slope FROM g)")
def release_from_terrain(spark, sf):
    cells, _ = _grid(spark, sf)
    return cells.select("row", "col", local.release_from_terrain(F.col("dem"), F.col("forest").cast("double")).alias("start"), F.round(local.cover_fraction(F.col("forest")), 6).alias("fraction"))


@query("SELECT c_custkey, CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY n DESC, w)-1 AS INTEGER) AS k, CASE WHEN n>=0 THEN 'n' ELSE 's' END || lpad(CAST(abs(n) AS VARCHAR),2,'0') || CASE WHEN w>=0 THEN 'e' ELSE 'w' END || lpad(CAST(abs(w) AS VARCHAR),3,'0') AS tile FROM (SELECT c_custkey, CAST(c_custkey*7919 % 360 - 180 AS DOUBLE)+0.37 AS lon, CAST(c_custkey*104729 % 160 - 80 AS DOUBLE)+0.21 AS lat FROM customer), unnest(range(CAST(floor(lat-0.5) AS BIGINT)+1, CAST(ceil(lat+0.5) AS BIGINT)+1)) AS a(n), unnest(range(CAST(floor(lon-1) AS BIGINT), CAST(ceil(lon+1) AS BIGINT))) AS b(w)")
def degree_tiles(spark, sf):
    lon, lat = F.col("lon"), F.col("lat")
    names = S.degree_tiles(lon - 1, lat - 0.5, lon + 1, lat + 0.5)
    return _places(spark, sf).select("c_custkey", F.posexplode(names).alias("k", "tile"))


@query(f"WITH {G} SELECT band, value FROM (SELECT dem, CAST(forest AS DOUBLE) AS forest, CAST(pra AS DOUBLE) AS pra, CAST(patch AS DOUBLE) AS patch FROM g WHERE row=1 AND col=7) UNPIVOT (value FOR band IN (dem, forest, pra, patch))")
def sample_bands(spark, sf):
    return grids.sample_bands(_grid(spark, sf)[0].select("grid_id", "row", "col", "dem", "forest", "pra", "patch"), 1, 7)


@query("SELECT c_custkey, CAST(greatest(0, least(26, ceil(log2(2*pi()*6378137.0/256*cos(radians(lat))/(5 + c_custkey % 40))))) AS INTEGER) AS zoom FROM (SELECT c_custkey, CAST(c_custkey*104729 % 160 - 80 AS DOUBLE)+0.21 AS lat FROM customer)")
def native_zoom(spark, sf):
    return _places(spark, sf).select("c_custkey", S.native_zoom((5 + F.col("c_custkey") % 40).cast("double"), F.col("lat")).alias("zoom"))


@query(f"WITH {G} SELECT row, col, CASE WHEN dem<2050 AND dem+z_delta>2150 THEN 'btl,tln,alp' WHEN dem<2050 AND dem+z_delta>=2050 THEN 'btl,tln' WHEN dem<2050 THEN 'btl' WHEN dem>2150 THEN 'alp' WHEN dem+z_delta>2150 THEN 'tln,alp' ELSE 'tln' END AS bands FROM g")
def treeline_bands(spark, sf):
    d = _grid(spark, sf)[0].withColumn("min_elevation", F.col("dem")).withColumn("max_elevation", F.col("dem") + F.col("z_delta"))
    return forecast.with_bands(d, 2050, 2150).select("row", "col", F.array_join("bands", ",").alias("bands"))


@query("WITH z AS (SELECT 'z' || n_nationkey AS zone_id, 'a' || (n_nationkey % 4) AS area_id FROM nation), f AS (SELECT r_regionkey AS seq, 'f' || r_regionkey AS id, 'a' || (r_regionkey % 3) AS area_id, 'z' || (r_regionkey*3) AS p1, 'z' || (r_regionkey*2+1) AS p2 FROM region), m AS (SELECT zone_id, 0 AS how, seq, id FROM z JOIN f ON zone_id=p1 OR zone_id=p2 UNION ALL SELECT zone_id, 1, seq, id FROM z JOIN f USING (area_id)) SELECT zone_id, id AS forecast_id FROM m QUALIFY row_number() OVER (PARTITION BY zone_id ORDER BY how, seq) = 1")
def forecast_of_zone(spark, sf):
    n, r = F.col("n_nationkey"), F.col("r_regionkey")
    z = spark.read.parquet(f"{sf}/nation.parquet").select(F.concat(F.lit("z"), n).alias("zone_id"), F.concat(F.lit("a"), n % 4).alias("area_id"))
    f = spark.read.parquet(f"{sf}/region.parquet").select(r.alias("seq"), F.concat(F.lit("f"), r).alias("id"), F.concat(F.lit("a"), r % 3).alias("area_id"), F.array(F.concat(F.lit("z"), r * 3), F.concat(F.lit("z"), r * 2 + 1)).alias("polygons"))
    return forecast.forecast_of(z, f)


@query("WITH e AS (SELECT event_id, ['N','E','S',NULL][1 + event_id % 4] AS asp, ['btl','tln','alp'][1 + event_id % 3] AS band FROM events), p AS (SELECT * FROM (VALUES ('slab', 'N', 'alp', false), ('slab', 'E', 'tln', false), ('wet', 'S', 'btl', true)) t(type, a, b, odd)) SELECT event_id, type, CASE WHEN asp IS NULL THEN NULL WHEN bool_or(a=asp AND b=band) THEN true WHEN bool_or(odd) THEN NULL ELSE false END AS listed_here FROM e, p GROUP BY event_id, asp, band, type")
def problems_listed(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.lit("f").alias("forecast_id"), F.get(F.array(F.lit("N"), F.lit("E"), F.lit("S"), F.lit(None)), (F.col("event_id") % 4).cast("int")).alias("dominant_aspect"), F.array(F.get(F.array(F.lit("btl"), F.lit("tln"), F.lit("alp")), (F.col("event_id") % 3).cast("int"))).alias("bands"))
    p = spark.createDataFrame([("f", "slab", ["n_alp", "tln e"]), ("f", "wet", ["S-btl", "mystery"])], "forecast_id string, type string, codes array<string>")
    return forecast.problems_here(e, p).select("event_id", "type", "listed_here")


@query(f"WITH {G} SELECT max(CAST(z_delta*3 AS DOUBLE)) AS max_runout FROM g WHERE cell_count > 0")
def max_runout(spark, sf):
    return compare.max_runout(_grid(spark, sf)[0].withColumn("flow_distance", F.col("z_delta") * 3))


@query(f"{BASE} SELECT row, col, CASE WHEN aspect IS NULL THEN NULL ELSE ['N','NE','E','SE','S','SW','W','NW'][1 + CAST(floor((CAST(aspect AS DOUBLE)+22.5)/45) AS INTEGER) % 8] END AS sector FROM asp")
def aspect_sectors(spark, sf):
    cells, m = _grid(spark, sf)
    return focal.horn_aspect(cells, "dem", m.rows, m.cols).select("row", "col", S.aspect_sector(F.col("aspect")).alias("sector"))


@query(f"WITH {G} SELECT row, col, CAST(row AS INTEGER) % 2 AS parity FROM (SELECT row//2 AS row, col//2 AS col FROM g WHERE row%2=0 AND col%2=0)")
def overview(spark, sf):
    from ..sources.geotiff import overviews

    return overviews(_grid(spark, sf)[0], 1).select("row", "col", (F.col("row") % 2).alias("parity"))


@query(f"WITH RECURSIVE {G}, {BLOCK}, " + _REACH.format(w=50, t="pt", v="v", also="AND a.v<>0", alone="AND v<>0") + ", s AS (SELECT root, count(*) AS c FROM comp GROUP BY 1) SELECT CAST(dense_rank() OVER (ORDER BY root) AS INTEGER) AS label, c AS cells FROM s")
def component_sizes(spark, sf):
    cells, m = _grid(spark, sf)
    n = zonal.numbered(zonal.label(_blocks(cells), "v", m.cols, tile=16))
    return n.where("label > 0").groupBy("label").agg(F.count("*").alias("cells"))


_P = 7


@query(f"""WITH RECURSIVE {G}, n AS (SELECT col, count(*) AS n FROM g WHERE pra = 1 AND col % 3 <> 1 GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY col) AS k FROM n), t AS (SELECT sum(n) / {_P} AS share FROM n),
 w(k, piece, held) AS (SELECT k, 0, n FROM k WHERE k = 1 UNION ALL SELECT k.k, CASE WHEN held >= share AND piece < {_P - 1} THEN piece + 1 ELSE piece END, CASE WHEN held >= share AND piece < {_P - 1} THEN n ELSE held + n END FROM w JOIN k ON k.k = w.k + 1, t)
 SELECT g.row, g.col, piece FROM g JOIN k USING (col) JOIN w USING (k) WHERE pra = 1""")
def release_pieces(spark, sf):
    cells, _ = _grid(spark, sf)
    return release.split_release(cells.withColumn("start", F.when(F.col("col") % 3 != 1, F.col("pra")).otherwise(0)), "start", _P)


@query(f"WITH {G} SELECT row, col, CASE WHEN col < 20 OR (col < 30 AND row % 3 = 0) THEN dem + 1 WHEN row % 3 <> 0 THEN dem END AS dem FROM g")
def mosaic(spark, sf):
    cells, m = _grid(spark, sf)
    root, d = f"{scratch_dir(spark)}/mosaic-{uuid.uuid4().hex}", cells.select("grid_id", "row", "col", "dem")
    west = d.where("col < 30").withColumn("dem", F.col("dem") + 1)
    east = d.where("col >= 20").withColumns({"col": F.col("col") - 20, "dem": F.when(F.col("row") % 3 != 0, F.col("dem"))})
    grids.write_grid(west, f"{root}/w", replace(m, cols=30))
    grids.write_grid(east, f"{root}/e", replace(m, x0=m.x0 + 20 * m.dx, cols=m.cols - 20))
    return grids.mosaic(spark, f"{root}/{{tile}}", ["w", "e"])[0].select("row", "col", F.col("dem").cast("double").alias("dem"))


@query(f"""WITH {G}, {ROUTES}, a AS (SELECT route_id, stretch, length, CAST(floor((CASE WHEN dem IS NOT NULL THEN CAST(dem AS INTEGER) % 360 END + 22.5) / 45) AS INTEGER) % 8 AS s FROM st),
 l AS (SELECT route_id, stretch, s, sum(length) AS m FROM a WHERE s IS NOT NULL GROUP BY 1, 2, 3), b AS (SELECT route_id, stretch, s FROM l QUALIFY row_number() OVER (PARTITION BY route_id, stretch ORDER BY round(m, 6) DESC, s DESC) = 1)
 SELECT route_id, CAST(stretch AS BIGINT) AS stretch, ['N','NE','E','SE','S','SW','W','NW'][1 + s] AS dominant_aspect FROM (SELECT DISTINCT route_id, stretch FROM st) LEFT JOIN b USING (route_id, stretch)""")
def dominant_aspects(spark, sf):
    cells, m = _grid(spark, sf)
    layers = cells.select("grid_id", "row", "col", F.col("patch").alias("exposure"), (F.col("dem").cast("int") % 360).cast("double").alias("aspect"))
    return route.evaluate(grids.routes(spark, sf), layers, m).select("route_id", "stretch", "dominant_aspect")


@query(f"WITH {G}, {ROUTES} SELECT round(sum(CASE WHEN stretch % 3 <> 0 THEN length ELSE 0 END), 1) AS no_zone_m FROM st")
def no_zone_metres(spark, sf):
    s = _stretches(spark, sf)
    zones = s.where("stretch % 3 = 0").select("route_id", "stretch", F.concat(F.lit("z"), F.col("stretch") % 2).alias("zone_id"))
    f = spark.createDataFrame([("z0", "f0"), ("z1", "f1")], "zone_id string, forecast_id string")
    return forecast.no_zone_m(forecast.annotate(s, zones, f))


@query(f"WITH {G} SELECT row, col, 10 * (col + 0.5::DOUBLE) AS x, 10 * (nr - row - 0.5::DOUBLE) AS y FROM g, d WHERE row BETWEEN 1 AND nr - 2")
def cell_centres(spark, sf):
    cells, m = _grid(spark, sf)
    x, y = m.dx * (F.col("col") + 0.5) + m.x0, m.y0 - m.dy * (F.col("row") + 0.5)
    p = cells.where(F.col("row").between(1, m.rows - 2)).select(x.alias("x"), y.alias("y"))
    row, col = route.cell_of(F.col("x"), F.col("y"), m)
    return p.select(row.alias("row"), col.alias("col"), "x", "y")


@query(f"{BASE}, {SMOOTH} SELECT CAST(row - 1 AS INTEGER) AS row, CAST(col - 1 AS INTEGER) AS col, round(CAST(slope AS DOUBLE), 4) AS slope, slope_class FROM cl JOIN sl USING (row, col), d WHERE row BETWEEN 1 AND nr - 2 AND col BETWEEN 1 AND nc - 2")
def terrain_area(spark, sf):
    cells, m = _grid(spark, sf)
    out, _ = terrain.area(cells, m, m.dx, P)
    return out.select("row", "col", r4("slope").alias("slope"), "slope_class")


def queries():
    return dict(Q)


def oracle_sql():
    return dict(SQL)
