"""Per-cell rules as column expressions. Rules that reassign a value in turn are one CASE over the value as it was: what
later rules make of a code is settled beforehand, so no expression is nested in itself."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..config import ClassifyParams, PraParams
from ..functions.scalars import cauchy, round5, saturating
from ..model import NODATA
from .focal import uniform_filter

#: Class by merged class 0 to 4, for each forest code, without and with a release area. Fixed values.
LOOKUP = {
    (0, 10): (0, 1, 2, 3, 4), (0, 20): (0, 1, 1, 2, 3), (0, 30): (0, 1, 1, 1, 3), (0, 40): (0, 1, 1, 1, 2),
    (100, 10): (0, 1, 2, 3, 4), (100, 20): (0, 1, 1, 2, 3), (100, 30): (0, 1, 1, 2, 3), (100, 40): (0, 1, 1, 2, 2),
}


def truncated(x: Column) -> Column:
    """int16 of a band: no data and NaN give -9999."""
    return F.when(x.isNull() | F.isnan(x.cast("double")), F.lit(NODATA)).otherwise(saturating(x)).cast("int")


def _in_turn(v: Column, rules: list[tuple]) -> Column:
    """v after rules (test, code) that each see what the ones before made of it. A test takes a column or a number."""
    out = F
    for k, (test, code) in enumerate(rules):
        for later, to in rules[k + 1 :]:
            code = to if later(code) else code
        out = out.when(test(v), code)
    return out.otherwise(v)


def slope_class(s: Column, smoothed: Column, p: ClassifyParams) -> Column:
    bands = ((0, p.sat01, 0), (p.sat01, p.sat12, 1), (p.sat12, p.sat23, 2), (p.sat23, 100, 3))
    v = _in_turn(s, [(lambda v, lo=lo, hi=hi: (v > lo) & (v <= hi), k) for lo, hi, k in bands])
    return F.when((smoothed > p.sat34) & (smoothed <= 100), 4).otherwise(v).cast("int")


def slope_classes(cells: DataFrame, slope: str, p: ClassifyParams, rows: int, cols: int) -> DataFrame:
    """Adds slope_int, slope_smooth and slope_class."""
    d = cells.withColumn("slope_int", truncated(F.col(slope))).withColumn("_pos", F.greatest("slope_int", F.lit(0)))
    d = uniform_filter(d, "_pos", p.win_size, rows, cols, "slope_smooth").drop("_pos")
    return d.withColumn("slope_class", slope_class(F.col("slope_int"), F.col("slope_smooth"), p))


def runout_class(v: Column, p: ClassifyParams) -> Column:
    """From a travel angle (int): 1 to 3; 90 and more pass, no data gives 0."""
    above = lambda t, k: _in_turn(v, [(lambda v: v < t, 0), (lambda v: (v >= t) & (v < 90), k)])
    return F.greatest(_in_turn(v, [(lambda v: (v >= 0) & (v < 90), 1)]), above(p.aat2, 2), above(p.aat3, 3))


def count_class(v: Column, p: ClassifyParams) -> Column:
    return _in_turn(v, [
        (lambda v: v == NODATA, 0), (lambda v: (v >= 0) & (v <= p.cc1), 1), (lambda v: (v > p.cc1) & (v <= p.cc2), 2), (lambda v: (v > p.cc2) & (v <= 20000), 3),
    ])


def forest_code(v: Column, p: ClassifyParams) -> Column:
    open_ = F.when(v > p.tree1, -1).when(v >= 0, 10).otherwise(v)
    sparse = F.when((v > p.tree1) & (v <= p.tree2), 20).otherwise(-1)
    dense = F.when((v > p.tree2) & (v <= p.tree3), 30).otherwise(-1)
    return F.greatest(open_, sparse, dense, F.when(v < p.tree3, -1).otherwise(40))


def release_code(v: Column) -> Column:
    return F.when(v == 1, 100).otherwise(v)


def combine(merge: Column, forest: Column, release: Column) -> Column:
    """The sum of the codes looked up; sums that aren't listed pass; negatives give 0. 40 literals: no join."""
    key = merge + forest + release
    table = F.create_map(*[F.lit(x) for (r, f), classes in LOOKUP.items() for m, c in enumerate(classes) for x in (m + f + r, c)])
    return F.greatest(F.coalesce(F.try_element_at(table, key), key), F.lit(0))


def memberships(slope: Column, shelter: Column, forest: Column, p: PraParams) -> tuple[Column, Column, Column]:
    f = cauchy(forest, *p.forest)
    f = F.when(f.isNull() | F.isnan(f) | (f <= 1e-5), F.lit(1.0)).otherwise(f)
    return round5(cauchy(slope, *p.slope)), round5(cauchy(shelter, *p.windshelter)), round5(f)


def fuzzy(s: Column, w: Column, f: Column, threshold: float) -> tuple[Column, Column]:
    """(continuous, binary); a value at the threshold itself is kept in the binary band."""
    m = F.least(s, w, f)
    pra = round5((1 - m) * m + m * (s + w + f) / 3) * 100
    whole, limit = saturating(pra), threshold * 100
    return whole.cast("int"), F.when((pra >= 0) & (pra < limit), 0).when((pra > limit) & (pra <= 100), 1).otherwise(whole).cast("int")


def overhead(count: Column, z_delta: Column, count_max: Column, max_z: float) -> Column:
    scaled = F.when((count > 0) & (count_max > 1), F.log(count.cast("double")) / F.log(count_max.cast("double")) * 100).otherwise(0.0)
    return saturating((scaled + z_delta / max_z * 100) / 2).cast("int")


def cover_fraction(x: Column) -> Column:
    return F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x.cast("double") / 100)), F.lit(0.0))


def release_from_terrain(dem: Column, slope: Column) -> Column:
    return F.when((dem > 1800) & (slope > 30) & (slope < 35), 1).otherwise(0)


def slope_weight_area(cell_x: float, cell_y: float, size_m2: float) -> int:
    """Cells of the smallest island that stays: half to even."""
    return int(round(size_m2 / (cell_x * cell_y))) if math.isfinite(size_m2) else 0
