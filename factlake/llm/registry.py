"""The queries of this package and their SQL, for the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audit, chat, decontaminate, jaccard, search
from .audit import op12_filter_audit
from .chat import op10_perspective_rotation
from .common import ready
from .decontaminate import op4_decontaminate
from .fingerprint import op6_locally_consistent_parsing
from .html import op7_html_extraction
from .jaccard import op2_ngram_jaccard_join
from .langid import op9_language_id
from .maxent import op11_maxent_scores
from .packing import op1_best_fit_packing
from .quality import op5_co_training
from .search import op13_ranked_search
from .secrets import op3_secret_scan
from .sharding import op8_virtual_slots

Query = Callable[[SparkSession, str], DataFrame]


def _readied(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ready(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Query]:
    found = [
        op1_best_fit_packing, op2_ngram_jaccard_join, op3_secret_scan, op4_decontaminate, op5_co_training, op6_locally_consistent_parsing,
        op7_html_extraction, op8_virtual_slots, op9_language_id, op10_perspective_rotation, op11_maxent_scores, op12_filter_audit, op13_ranked_search,
    ]
    return {f.__name__: _readied(f) for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        op2_ngram_jaccard_join.__name__: jaccard.ORACLE, op4_decontaminate.__name__: decontaminate.ORACLE, op10_perspective_rotation.__name__: chat.ORACLE,
        op12_filter_audit.__name__: audit.ORACLE, op13_ranked_search.__name__: search.ORACLE,
    }
