"""Parameters: defaults, region presets from TOML, validation."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields, replace

from .model import fnv1a64_hex

#: Thresholds of forest classes and Cauchy (a, b, c) by forest measure. Fixed values.
TREE = {"pcc": (10, 50, 65), "bav": (10, 20, 25), "stems": (100, 250, 500), "sen2ccc": (20, 60, 85)}
FOREST_CAUCHY = {"stems": (350, 2, -120), "pcc": (40, 3.5, -15), "bav": (20, 3.5, -10), "sen2ccc": (50, 1.5, 0)}


def _ascending(*v: float) -> None:
    if any(a >= b for a, b in zip(v, v[1:])):
        raise ValueError(f"thresholds must ascend: {v}")


@dataclass(frozen=True)
class ClassifyParams:
    sat01: float = 15
    sat12: float = 18
    sat23: float = 28
    sat34: float = 39
    win_size: int = 3
    aat1: int = 18
    aat2: int = 24
    aat3: int = 33
    cc1: int = 5
    cc2: int = 40
    isl_size_m2: float = 30000
    tree1: int = 10
    tree2: int = 50
    tree3: int = 65

    def __post_init__(self):
        _ascending(self.sat01, self.sat12, self.sat23, self.sat34)
        _ascending(self.aat1, self.aat2, self.aat3)
        _ascending(self.cc1, self.cc2)
        _ascending(self.tree1, self.tree2, self.tree3)
        if self.win_size < 1 or self.win_size % 2 == 0:
            raise ValueError("win_size must be odd")
        if self.isl_size_m2 < 0:
            raise ValueError("isl_size_m2 must not be negative")


@dataclass(frozen=True)
class PraParams:
    radius_m: float = 60
    prob: float = 0.5
    wind_dir: float = 0
    wind_tol: float = 180
    threshold: float = 0.15
    sieve_cells: int = 3
    slope: tuple = (11, 4, 43)
    windshelter: tuple = (3, 10, 3)
    forest: tuple = FOREST_CAUCHY["pcc"]

    def __post_init__(self):
        if not 0 <= self.prob <= 1 or not 0 <= self.threshold <= 1 or self.radius_m <= 0 or not 0 <= self.wind_tol <= 180:
            raise ValueError("release parameters out of range")


@dataclass(frozen=True)
class FlowParams:
    alpha: float = 24
    exponent: float = 8
    flux: float = 0.003
    max_z: float = 270

    def __post_init__(self):
        if not 0 < self.alpha < 90 or self.exponent <= 0 or not 0 < self.flux < 1 or self.max_z <= 0:
            raise ValueError("runout parameters out of range")


@dataclass(frozen=True)
class Params:
    classify: ClassifyParams = field(default_factory=ClassifyParams)
    pra: PraParams = field(default_factory=PraParams)
    flow: FlowParams = field(default_factory=FlowParams)
    prep: dict = field(default_factory=dict)
    hash: str = ""

    def pad_m(self) -> float:
        if "pad_m" not in self.prep:
            raise ValueError("prep.pad_m is unset on purpose; give one")
        return float(self.prep["pad_m"])


def merge(base: dict, over: dict) -> dict:
    out = dict(base)
    for k, v in over.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


class Config:
    """schema_version = 1, sections [prep] [classify] [pra] [flow], presets in [regions.<name>]."""

    SECTIONS = {"classify": ClassifyParams, "pra": PraParams, "flow": FlowParams}

    def __init__(self, text: str):
        self.data = tomllib.loads(text)
        self.hash = fnv1a64_hex(text.encode())
        if self.data.get("schema_version") != 1:
            raise ValueError("schema_version must be 1")
        unknown = set(self.data) - {"schema_version", "regions", "prep", *self.SECTIONS}
        if unknown:
            raise ValueError(f"unknown keys: {sorted(unknown)}")
        for name in [None, *self.region_names()]:
            self.params(name)

    def region_names(self) -> list[str]:
        return sorted(self.data.get("regions", {}))

    def params(self, region: str | None = None) -> Params:
        data = {k: v for k, v in self.data.items() if k not in ("schema_version", "regions")}
        if region is not None:
            if region not in self.data.get("regions", {}):
                raise ValueError(f"no such region: {region}")
            data = merge(data, {k: v for k, v in self.data["regions"][region].items() if k != "description"})
        unknown = set(data) - {"prep", *self.SECTIONS}
        if unknown:
            raise ValueError(f"unknown keys: {sorted(unknown)}")
        made = {}
        for name, kind in self.SECTIONS.items():
            given = data.get(name, {})
            bad = set(given) - {f.name for f in fields(kind)}
            if bad:
                raise ValueError(f"unknown keys in {name}: {sorted(bad)}")
            made[name] = replace(kind(), **{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})
        return Params(**made, prep=data.get("prep", {}), hash=self.hash)
