"""Registered queries of the training-data operators and their DuckDB SQL."""
from __future__ import annotations

from . import decontaminate, filter_audit, line_dedup, mixing, prefix_trie
from .decontaminate import op9_decontamination
from .embeddings import op3_embedding_near_dedup
from .filter_audit import op13_filter_audit
from .language import op8_language_id
from .license import op1_license_scan
from .line_dedup import op10_line_dedup
from .lm_score import op4_lm_score
from .mixing import op5_mixing
from .ngram_join import op2_ngram_jaccard_join
from .page_text import op7_page_text
from .prefix_trie import op11_prefix_trie
from .quality_rules import op12_quality_rules
from .sharding import op6_sharding

QUERIES = {f.__name__: f for f in (
    op1_license_scan, op2_ngram_jaccard_join, op3_embedding_near_dedup, op4_lm_score, op5_mixing, op6_sharding,
    op7_page_text, op8_language_id, op9_decontamination, op10_line_dedup,
    op11_prefix_trie, op12_quality_rules, op13_filter_audit)}

#: The others have parts that SQL can't express; tests hold them against brute force.
ORACLE: dict[str, str] = {"op5_mixing": mixing.SQL, "op9_decontamination": decontaminate.SQL,
                          "op10_line_dedup": line_dedup.SQL, "op11_prefix_trie": prefix_trie.SQL,
                          "op13_filter_audit": filter_audit.SQL}
