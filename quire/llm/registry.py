"""Queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from quire.llm import oracles
from quire.llm.decontamination import op1_decontamination
from quire.llm.fingerprints import op7_fingerprints
from quire.llm.language import op8_language_id
from quire.llm.lm_scoring import op3_lm_scoring
from quire.llm.packing import op9_best_fit_packing
from quire.llm.simhash import op5_simhash_near_dedup
from quire.llm.substring_dedup import op4_substring_dedup
from quire.llm.suffix_dedup import op2_suffix_dedup
from quire.llm.toxicity import op6_toxicity
from quire.llm.warc import op10_warc

_OPERATORS = (
    op1_decontamination, op2_suffix_dedup, op3_lm_scoring, op4_substring_dedup, op5_simhash_near_dedup,
    op6_toxicity, op7_fingerprints, op8_language_id, op9_best_fit_packing, op10_warc,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _OPERATORS} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontamination": oracles.DECONTAMINATION,
        "op2_suffix_dedup": oracles.SUFFIX,
        "op4_substring_dedup": oracles.SUBSTRING,
        "op10_warc": oracles.WARC,
    }
