"""The training-data queries and the SQL that DuckDB can check them with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat_format import ORACLE_SQL as CHAT_SQL
from .chat_format import op2_chat_format
from .compression_classifier import op7_quality_classifier
from .html_extraction import op3_html_extraction
from .line_dedup import ORACLE_SQL as LINE_DEDUP_SQL
from .line_dedup import op9_line_dedup
from .ngram_jaccard import op6_ngram_jaccard
from .packing import op4_packing
from .piece_sampling import op10_piece_sampling
from .projection_forest import op5_projection_forest
from .quality_rules import op1_quality_rules
from .token_counts import op8_token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_chat_format": op2_chat_format,
    "op3_html_extraction": op3_html_extraction,
    "op4_packing": op4_packing,
    "op5_projection_forest": op5_projection_forest,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_token_counts": op8_token_counts,
    "op9_line_dedup": op9_line_dedup,
    "op10_piece_sampling": op10_piece_sampling,
}

#: Only what SQL can express; the others are tested against brute force in tests/llm.
ORACLE_SQL: dict[str, str] = {"op2_chat_format": CHAT_SQL, "op9_line_dedup": LINE_DEDUP_SQL}
