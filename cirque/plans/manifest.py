"""The manifest of a region build: every parameter, the attempts, class counts and timings, as TOML."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame

from ..config import Params
from ..model import DISCLAIMER, GridMeta
from ..operators.compare import class_histogram
from ..operators.region import Attempt


def _value(v) -> str:
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(_value, v)) + "]"
    return repr(v) if isinstance(v, (int, float)) else json.dumps(str(v))


def to_toml(data: dict, prefix: str = "") -> str:
    """Scalars first, then a table for each dict and an array of tables for each list of dicts. Nulls are left out."""
    nested = {k: v for k, v in data.items() if isinstance(v, dict) or isinstance(v, list) and v and isinstance(v[0], dict)}
    out = "".join(f"{json.dumps(k)} = {_value(v)}\n" for k, v in data.items() if k not in nested and v is not None)
    for k, v in nested.items():
        name = prefix + json.dumps(k)
        for part in v if isinstance(v, list) else [v]:
            out += f"\n[[{name}]]\n" if isinstance(v, list) else f"\n[{name}]\n"
            out += to_toml(part, name + ".")
    return out


def manifest(name: str, cells: DataFrame, meta: GridMeta, params: Params, attempts: list[Attempt], timings: dict[str, float] | None = None) -> str:
    """One aggregate over the classes of the build; the rest is known to the driver."""
    counts = {("nodata" if r["class"] is None else str(r["class"])): r["cells"] for r in class_histogram(cells, "exposure").orderBy("class").collect()}  # a row per class
    sections = {k: asdict(getattr(params, k)) for k in ("classify", "pra", "flow")}
    return to_toml({
        "region": name, "disclaimer": DISCLAIMER, "config_hash": params.hash, "sufficient_pad": bool(attempts and attempts[-1].sufficient),
        "grid": asdict(meta), **sections, "prep": params.prep, "class_cells": counts, "timings_s": timings or {}, "attempts": [asdict(a) for a in attempts],
    })
