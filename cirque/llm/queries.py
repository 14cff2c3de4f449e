"""The queries of this subpackage; an oracle where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracle
from .decontaminate import op7_decontaminate
from .html import op1_html_main_text
from .linededup import op10_line_dedup
from .packing import op9_pattern_packing
from .quality import op6_quality_crf
from .rules import op8_quality_rules
from .sharding import op3_hilbert_shards
from .simhash import op5_simhash
from .urls import op4_url_filter
from .warc import op2_warc


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (
        op1_html_main_text, op2_warc, op3_hilbert_shards, op4_url_filter, op5_simhash, op6_quality_crf,
        op7_decontaminate, op8_quality_rules, op9_pattern_packing, op10_line_dedup, pipeline,
    )
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    """The others train, align or tokenize in ways SQL doesn't; tests hold them to brute force."""
    return {"op2_warc": oracle.WARC, "op4_url_filter": oracle.url_filter(), "op8_quality_rules": oracle.quality_rules()}
