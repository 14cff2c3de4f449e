"""The corpus pipeline: documents through five stages, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cirque.llm.common import materialise, table
from cirque.llm.decontaminate import drop_contaminated
from cirque.llm.linededup import dedup_stage
from cirque.llm.packing import pack_stage
from cirque.llm.quality import keep_good
from cirque.llm.simhash import keep_first

#: (name, function of (spark, docs, sf_dir)), in order. The last returns the packed pieces.
STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", dedup_stage),
    ("SimHash near-dedup", keep_first),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack_stage),
]

#: A trained field, ball hashing, alignment and a tokenizer: not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), "stage-" + name.lower().replace(" ", "-"))
    return docs
