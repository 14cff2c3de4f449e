"""Region build: widen the window until runout stays inside it, then classify and trim."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..config import Params
from ..model import GridMeta
from ..session import materialise
from .classify import classify, with_overhead
from .compare import max_runout
from .focal import terrain as slope_and_aspect
from .release import release_areas
from .runout import runout
from .zonal import trim

START_PAD, MAX_PAD = 1000.0, 10000.0


@dataclass(frozen=True)
class Attempt:
    pad_m: float
    release_cells: int
    max_runout_m: float
    sufficient: bool


def next_pad(pad: float, runout_m: float) -> float:
    return max(pad + 500, min(MAX_PAD, math.ceil(runout_m * 1.5 / 500) * 500)) if pad < MAX_PAD else MAX_PAD


def build(window: Callable[[float], tuple[DataFrame, GridMeta]], params: Params = Params(), start_pad: float = START_PAD, max_pad: float = MAX_PAD, halo: int = 512) -> tuple[DataFrame, GridMeta, list[Attempt]]:
    """window(pad_m) -> (cells with dem and forest in per cent, their meta). Returns the trimmed layers, their
    meta and the attempts; the last attempt tells whether its pad was enough. One action per attempt."""
    pad, attempts = start_pad, []
    while True:
        cells, meta = window(pad)
        d = release_areas(cells, "dem", "forest", meta, params.pra)
        d = d.withColumn("_wood", F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("forest") / 100)), F.lit(0.0)))
        d = materialise(runout(d, "dem", "pra", "_wood", meta, params.flow, halo=halo).drop("_wood"), "region")
        far = float(max_runout(d).first()["max_runout"] or 0.0)
        attempts.append(Attempt(pad, d.where("pra = 1").count(), far, far < pad))
        if far < pad or pad >= max_pad:
            break
        pad = min(max_pad, max(pad + 500, math.ceil(far * 1.5 / 500) * 500))
    d = with_overhead(d, params.flow.max_z)
    d = slope_and_aspect(d, "dem", meta.dx, meta.dy, meta.rows, meta.cols)
    d = classify(d, meta, params.classify)
    n = int(pad / meta.dx)
    return trim(d, n, meta.rows, meta.cols), meta.trimmed(n), attempts
