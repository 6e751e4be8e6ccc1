"""Registered queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import conversations, lines, mixing, pii, rules, secrets, substrings, tokens, whitening
from .conversations import op11_conversation_repair
from .decontam import op7_decontaminate
from .langid import op8_language_id
from .lines import op12_line_dedup
from .mixing import op5_mixing
from .quality import op2_line_crf
from .pii import op9_pii
from .rules import op6_quality_rules
from .secrets import op3_secret_scan
from .simhash import op1_simhash_dedup
from .substrings import op10_suffix_dedup
from .tokens import op4_token_counts
from .whitening import op13_whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_dedup": op1_simhash_dedup,
    "op2_line_crf": op2_line_crf,
    "op3_secret_scan": op3_secret_scan,
    "op4_token_counts": op4_token_counts,
    "op5_mixing": op5_mixing,
    "op6_quality_rules": op6_quality_rules,
    "op7_decontaminate": op7_decontaminate,
    "op8_language_id": op8_language_id,
    "op9_pii": op9_pii,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_line_dedup": op12_line_dedup,
    "op13_whitening": op13_whitening,
    # Parts of operators beside these: what SQL can say of them, and token counts of given fields.
    "secret_base_spans": secrets.secret_base_spans,
    "quality_base": rules.quality_base,
    "page_field_tokens": tokens.page_field_tokens,
    "embedding_deviations": whitening.embedding_deviations,
}

ORACLE_SQL: dict[str, str] = {
    "op5_mixing": mixing.ORACLE_SQL,
    "op9_pii": pii.ORACLE_SQL,
    "op10_suffix_dedup": substrings.ORACLE_SQL,
    "op11_conversation_repair": conversations.ORACLE_SQL,
    "op12_line_dedup": lines.ORACLE_SQL,
    "embedding_deviations": whitening.DEVIATIONS_SQL,
    "secret_base_spans": secrets.BASE_SQL,
    "quality_base": rules.BASE_SQL,
}
