"""Session helpers that the operators share: tables, scratch space, hidden column names."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import materialise, scratch_dir

#: White space as every contract here defines it: space and 0x09 to 0x0D. Fixed value.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


ARROW_ROWS = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """df, with its session's Arrow batches held to ARROW_ROWS rows: whole texts are long rows, and a batch is in
    memory twice, off the JVM's heap and in the worker. A smaller setting of the session stays. Spark's own bound of
    64 MB a batch (spark.sql.execution.arrow.maxBytesPerBatch) holds besides, so rows of long texts come in fewer.
    The setting is read when a plan runs, so it can't be taken back here: it stays with the session."""
    name, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(name)) <= ARROW_ROWS:
        conf.set(name, str(ARROW_ROWS))
    return df


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of so many rows for the jobs run inside: for kernels over narrow rows of numbers."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most so many rows: what a kernel holds as Python objects at once."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def words_of(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+`; an empty array for null."""
    flat = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\f\r", "     ")
    return F.filter(F.split(flat, " "), lambda w: w != "")


def joinable(df: DataFrame, name: str, max_rows: int = 100_000, max_chars: int = 8_000_000) -> DataFrame:
    """df, written once; marked for broadcast only if its counted rows and characters are within the
    bounds. Beyond them it stays a plain table and the join shuffles (AQE splits skewed keys)."""
    df = materialise(df, name)
    size = F.lit(0).cast("long")
    for f in df.schema.fields:
        size = size + (F.coalesce(F.length(F.col(f.name).cast("string")), F.lit(0)) if f.dataType.typeName() in ("string", "binary") else F.lit(8))
    r = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("c")).first()
    return F.broadcast(df) if r["n"] <= max_rows and r["c"] <= max_chars else df
