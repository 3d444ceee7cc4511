"""Registered queries of the subpackage."""

from __future__ import annotations

from .bpe import op2_bpe
from .decontaminate import op7_decontamination
from .html import op1_html_text
from .language import op9_language_id
from .near_dedup import ORACLE_SQL as _DEDUP_SQL
from .near_dedup import op3_near_dedup
from .perplexity import op5_quality_classifier
from .quality_rules import ORACLE_SQL as _QUALITY_SQL
from .quality_rules import op6_quality_rules
from .secrets import op4_secrets
from .token_counts import op8_token_counts
from .urls import op10_url_filters

QUERIES = {
    "op1_html_text": op1_html_text,
    "op2_bpe": op2_bpe,
    "op3_near_dedup": op3_near_dedup,
    "op4_secrets": op4_secrets,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_quality_rules": op6_quality_rules,
    "op7_decontamination": op7_decontamination,
    "op8_token_counts": op8_token_counts,
    "op9_language_id": op9_language_id,
    "op10_url_filters": op10_url_filters,
}


def _pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = _pipeline

ORACLE_SQL: dict[str, str] = {"op3_near_dedup": _DEDUP_SQL, "op6_quality_rules": _QUALITY_SQL}
