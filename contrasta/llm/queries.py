"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from .chat_format import OP4_SQL, op4_chat_format
from .decontaminate import op2_decontaminate
from .exact_dedup import OP9_SQL, op9_exact_dedup
from .filter_audit import OP11_SQL, op11_filter_audit
from .language_id import op5_language_id
from .line_dedup import op1_line_dedup
from .lm_scoring import op3_lm_scoring
from .ngram_jaccard import op10_ngram_jaccard_join
from .packing import op12_packing
from .prefix_trie import OP13_SQL, op13_prefix_trie
from .quality_cotraining import op8_quality
from .sentencepiece_codec import op7_sentencepiece
from .toxicity import op6_toxicity

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_decontaminate": op2_decontaminate,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_chat_format": op4_chat_format,
    "op5_language_id": op5_language_id,
    "op6_toxicity": op6_toxicity,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_quality_cotraining": op8_quality,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op11_filter_audit": op11_filter_audit,
    "op12_packing": op12_packing,
    "op13_prefix_trie": op13_prefix_trie,
}
SQL = {"op4_chat_format": OP4_SQL, "op9_exact_dedup": OP9_SQL, "op11_filter_audit": OP11_SQL, "op13_prefix_trie": OP13_SQL}
