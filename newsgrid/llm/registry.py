"""Queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from newsgrid.llm import hard_negatives, lexical_search, vector_dedup, vector_search
from newsgrid.llm.byte_bpe import op11_byte_bpe
from newsgrid.llm.hard_negatives import op12_hard_negatives
from newsgrid.llm.language_id import op4_language_id
from newsgrid.llm.language_model import op7_language_model
from newsgrid.llm.lexical_search import op13_lexical_search
from newsgrid.llm.line_dedup import op2_line_dedup
from newsgrid.llm.mixing import op6_mixing
from newsgrid.llm.near_dedup import op1_near_dedup
from newsgrid.llm.packing import op3_packing
from newsgrid.llm.token_counts import op5_token_counts
from newsgrid.llm.token_files import op10_token_files
from newsgrid.llm.vector_dedup import op9_vector_dedup
from newsgrid.llm.vector_search import op8_vector_search

QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op2_line_dedup": op2_line_dedup,
    "op3_packing": op3_packing,
    "op4_language_id": op4_language_id,
    "op5_token_counts": op5_token_counts,
    "op6_mixing": op6_mixing,
    "op7_language_model": op7_language_model,
    "op8_vector_search": op8_vector_search,
    "op9_vector_dedup": op9_vector_dedup,
    "op10_token_files": op10_token_files,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_lexical_search": op13_lexical_search,
}
ORACLE_SQL: dict[str, str] = {
    "op8_vector_search": vector_search.ORACLE_SQL,
    "op9_vector_dedup": vector_dedup.ORACLE_SQL,
    "op12_hard_negatives": hard_negatives.ORACLE_SQL,
    "op13_lexical_search": lexical_search.ORACLE_SQL,
}
