"""Registered queries of this subpackage and the SQL they are checked against."""

from __future__ import annotations

from brickledger.llm.hard_negatives import ORACLE_HARD_NEGATIVES, op13_hard_negatives
from brickledger.llm.html_text import op11_html_text
from brickledger.llm.line_dedup import ORACLE_LINE_DEDUP, op7_line_dedup
from brickledger.llm.mixing import ORACLE_MIXING, op1_mixing
from brickledger.llm.packing import op10_packing
from brickledger.llm.prefix_trie import ORACLE_PREFIX_TRIE, op12_prefix_trie
from brickledger.llm.quality import op3_quality
from brickledger.llm.simhash import op6_simhash
from brickledger.llm.substring_dedup import ORACLE_SUBSTRING_DEDUP, op9_substring_dedup
from brickledger.llm.token_counts import op5_token_counts
from brickledger.llm.topk import ORACLE_TOPK, op2_topk_search
from brickledger.llm.urls import ORACLE_URL_FILTERS, op8_url_filters
from brickledger.llm.vector_dedup import ORACLE_VECTOR_DEDUP, op4_vector_dedup

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_topk_search": op2_topk_search,
    "op3_quality": op3_quality,
    "op4_vector_dedup": op4_vector_dedup,
    "op5_token_counts": op5_token_counts,
    "op6_simhash": op6_simhash,
    "op7_line_dedup": op7_line_dedup,
    "op8_url_filters": op8_url_filters,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_packing": op10_packing,
    "op11_html_text": op11_html_text,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE = {
    "op1_mixing": ORACLE_MIXING,
    "op2_topk_search": ORACLE_TOPK,
    "op4_vector_dedup": ORACLE_VECTOR_DEDUP,
    "op7_line_dedup": ORACLE_LINE_DEDUP,
    "op8_url_filters": ORACLE_URL_FILTERS,
    "op9_substring_dedup": ORACLE_SUBSTRING_DEDUP,
    "op12_prefix_trie": ORACLE_PREFIX_TRIE,
    "op13_hard_negatives": ORACLE_HARD_NEGATIVES,
}
