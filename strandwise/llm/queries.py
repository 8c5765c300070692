"""Queries of this subpackage, for the registry at the repository top."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from .divergence import DIVERGENCE_SQL, op12_source_divergence
from .langid import op8_language
from .lexical import SEARCH_SQL, op13_lexical_search
from .lm import op4_language_model
from .mixing import TARGETS_SQL, mixing_targets, op9_mixing
from .nearest import op11_nearest
from .packing import op10_packing
from .pii import op1_personal_data
from .quality import COUNTS_SQL, op2_quality, quality_counts
from .simhash import op3_simhash
from .token_store import op5_token_files
from .topk import TOPK_SQL, op6_topk
from .url_rules import BASE_RULES_SQL, op7_url_filter, url_base_rules

QUERIES = (op1_personal_data, op2_quality, op3_simhash, op4_language_model, op5_token_files, op6_topk, op7_url_filter, op8_language, op9_mixing, op10_packing, op11_nearest, op12_source_divergence, op13_lexical_search)
#: What SQL can express of operators that it can't as a whole.
PARTS = (quality_counts, url_base_rules, mixing_targets)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (*QUERIES, *PARTS)} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    """SQL where it can express the query; hashes, tokenizers, compression and iteration have none there."""
    found = {"op6_topk": TOPK_SQL, "op12_source_divergence": DIVERGENCE_SQL, "op13_lexical_search": SEARCH_SQL, "quality_counts": COUNTS_SQL, "url_base_rules": BASE_RULES_SQL, "mixing_targets": TARGETS_SQL}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
