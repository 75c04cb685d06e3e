"""Queries of this subpackage, and SQL where it can express them."""

from __future__ import annotations

from .ann import op8_ann
from .bpe import op4_byte_bpe
from .conversation_trie import OP11_SQL, op11_conversation_trie
from .mixing import OP6_SQL, op6_mixing
from .pii import op5_pii
from .quality import op1_quality
from .simhash import op10_simhash
from .spelling import OP12_SQL, op12_spelling
from .suffix_dedup import op9_suffix_dedup
from .token_counts import op3_token_counts
from .topk import op2_topk
from .topk import SQL as OP2_SQL
from .toxicity import op7_toxicity
from .warc import OP13_SQL, op13_warc

QUERIES = {
    "op1_quality": op1_quality,
    "op2_topk": op2_topk,
    "op3_token_counts": op3_token_counts,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_pii": op5_pii,
    "op6_mixing": op6_mixing,
    "op7_toxicity": op7_toxicity,
    "op8_ann": op8_ann,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_simhash": op10_simhash,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_spelling": op12_spelling,
    "op13_warc": op13_warc,
}
ORACLE_SQL = {
    "op2_topk": OP2_SQL,
    "op6_mixing": OP6_SQL,
    "op11_conversation_trie": OP11_SQL,
    "op12_spelling": OP12_SQL,
    "op13_warc": OP13_SQL,
}
