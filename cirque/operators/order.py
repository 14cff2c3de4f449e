"""Previous rows and running sums along a total order, without a window over the whole table.

Rows are range-partitioned and sorted; what crosses from partition to partition is one row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialise


def in_order(df: DataFrame, *keys: str) -> DataFrame:
    """df with `_part` and its rows sorted within it: partitions are ranges of the keys. Written once."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialise(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id()), "in-order")


def with_previous(placed: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """placed with `prev_<column>` of the row before along the key (null for the first)."""
    w = Window.partitionBy("_part").orderBy(key)
    last = placed.groupBy("_part").agg(F.max(F.struct(key, *[F.col(c).alias(f"v_{c}") for c in columns])).alias("_end"))
    over = Window.orderBy("_part")  # one row per partition
    before = last.select("_part", F.lag("_end").over(over).alias("_before"))
    d = placed.withColumn("_first", F.row_number().over(w) == 1).withColumns({f"prev_{c}": F.lag(c).over(w) for c in columns}).join(F.broadcast(before), "_part")
    return d.withColumns({f"prev_{c}": F.when(F.col("_first"), F.col(f"_before.v_{c}")).otherwise(F.col(f"prev_{c}")) for c in columns}).drop("_first", "_before")


def running(placed: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """placed with the sum of value up to and with each row along the key."""
    d = placed.withColumn("_value", value)
    sums = d.groupBy("_part").agg(F.sum("_value").alias("_sum"))
    offsets = sums.select("_part", (F.sum("_sum").over(Window.orderBy("_part")) - F.col("_sum")).alias("_off"))  # one row per partition
    w = Window.partitionBy("_part").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn(name, F.sum("_value").over(w)).join(F.broadcast(offsets), "_part").withColumn(name, F.col(name) + F.col("_off")).drop("_value", "_off")
