"""The queries opN_<name> of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from tokenguard.llm.alignment import op11_alignment
from tokenguard.llm.audit import OP12_SQL, op12_filter_audit
from tokenguard.llm.bpe import op1_bpe
from tokenguard.llm.language import op6_language
from tokenguard.llm.mixing import OP9_SQL, op9_mixing
from tokenguard.llm.near_dedup import OP2_SQL, op2_near_dedup
from tokenguard.llm.ngram_join import OP3_SQL, op3_ngram_join
from tokenguard.llm.ppm import op5_lm_score
from tokenguard.llm.quality import op7_quality
from tokenguard.llm.secrets import op4_secrets
from tokenguard.llm.token_counts import op13_token_counts
from tokenguard.llm.topk import OP10_SQL, op10_topk
from tokenguard.llm.toxicity import op8_toxicity

QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_near_dedup": op2_near_dedup,
    "op3_ngram_join": op3_ngram_join,
    "op4_secrets": op4_secrets,
    "op5_lm_score": op5_lm_score,
    "op6_language": op6_language,
    "op7_quality": op7_quality,
    "op8_toxicity": op8_toxicity,
    "op9_mixing": op9_mixing,
    "op10_topk": op10_topk,
    "op11_alignment": op11_alignment,
    "op12_filter_audit": op12_filter_audit,
    "op13_token_counts": op13_token_counts,
}

ORACLE_SQL = {
    "op2_near_dedup": OP2_SQL,
    "op3_ngram_join": OP3_SQL,
    "op9_mixing": OP9_SQL,
    "op10_topk": OP10_SQL,
    "op12_filter_audit": OP12_SQL,
}
