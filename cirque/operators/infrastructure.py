"""Runout with infrastructure: which cells send flow onto it, and how much is at stake.

Release cells are worked from the highest down; one that an earlier path already reached is left out, so the order
matters and a grid's paths are one task (grids run in parallel). Ancestors of path cells on infrastructure get its value.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..config import FlowParams
from ..model import GridMeta
from .runout import follow


def back_calculation(path: list, infra: np.ndarray) -> dict[tuple[int, int], float]:
    """Value by cell of the path: the largest infrastructure value that its flow reaches."""
    out: dict[tuple[int, int], float] = {}
    for x in path:
        v = float(infra[x.row, x.col])
        if v > 0:
            todo, seen = [x], {id(x)}
            while todo:
                q = todo.pop()
                out[q.row, q.col] = max(out.get((q.row, q.col), 0.0), v)
                for p in q.parents:
                    if id(p) not in seen:
                        seen.add(id(p))
                        todo.append(p)
    return out


def runout_infrastructure(cells: DataFrame, dem: str, release: str, infra: str, meta: GridMeta, p: FlowParams = FlowParams()) -> DataFrame:
    """cells with backcalculation (0 where no flow to infrastructure starts or passes)."""
    size = meta.dx

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        r, c = pdf["row"].to_numpy(), pdf["col"].to_numpy()
        z, v = np.full((r.max() + 1, c.max() + 1), np.nan, np.float32), np.zeros((r.max() + 1, c.max() + 1))
        wood = np.zeros(z.shape, np.float32)
        z[r, c], v[r, c] = pdf["_z"].to_numpy(), pdf["_i"].fillna(0).to_numpy()
        own = pdf[(pdf["_r"] > 0) & pdf["_z"].notna()].sort_values(["_z", "row", "col"], ascending=False)
        hit, found = set(), {}
        for rr, cc in zip(own["row"].tolist(), own["col"].tolist()):
            if (rr, cc) in hit:
                continue
            path = follow(z, wood, rr, cc, size, p, (False,) * 4)
            hit.update((x.row, x.col) for x in path)
            for k, value in back_calculation(path, v).items():
                found[k] = max(found.get(k, 0.0), value)
        return pd.DataFrame([(pdf["grid_id"].iat[0], *k, x) for k, x in found.items()], columns=["grid_id", "row", "col", "backcalculation"])

    thin = cells.select("grid_id", "row", "col", F.col(dem).cast("double").alias("_z"), F.col(release).cast("double").alias("_r"), F.col(infra).cast("double").alias("_i"))
    got = thin.groupBy("grid_id").applyInPandas(kernel, "grid_id long, row int, col int, backcalculation double")
    return cells.join(got, ["grid_id", "row", "col"], "left").withColumn("backcalculation", F.coalesce("backcalculation", F.lit(0.0)).cast("float"))
