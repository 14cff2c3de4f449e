"""Reductions over grids: histogram, agreement, runout distance."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def class_histogram(cells: DataFrame, value: str) -> DataFrame:
    return cells.groupBy(F.col(value).alias("class")).agg(F.count("*").alias("cells"))


def agreement(a: DataFrame, b: DataFrame, value: str, circular: bool = False) -> DataFrame:
    """compared, mismatched (data in one only), max_diff, mean_diff of two grids."""
    x = a.select("grid_id", "row", "col", F.col(value).alias("_a"))
    y = b.select("grid_id", "row", "col", F.col(value).alias("_b"))
    d = F.abs(F.col("_a").cast("double") - F.col("_b").cast("double"))
    d = F.least(d, 360 - d) if circular else d
    j = x.join(y, ["grid_id", "row", "col"], "full").withColumn("_d", d)
    return j.agg(
        F.count("_d").alias("compared"), F.count_if(F.col("_a").isNull() != F.col("_b").isNull()).alias("mismatched"), F.max("_d").alias("max_diff"), F.avg("_d").alias("mean_diff")
    )


def max_runout(cells: DataFrame) -> DataFrame:
    return cells.agg(F.max(F.when(F.col("cell_count") > 0, F.col("flow_distance"))).alias("max_runout"))
