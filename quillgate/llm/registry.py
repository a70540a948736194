"""Queries and oracle SQL of this subpackage."""

from __future__ import annotations

from quillgate.llm.hamming import OP1_SQL, op1_hamming_topk
from quillgate.llm.hnsw import op10_hnsw_near_dedup
from quillgate.llm.line_dedup import OP4_SQL, op4_line_dedup
from quillgate.llm.minhash import op2_minmax_near_dedup
from quillgate.llm.mixing import OP7_SQL, op7_mixing
from quillgate.llm.packing import op8_packing
from quillgate.llm.pii import op5_pii
from quillgate.llm.token_store import op3_token_store
from quillgate.llm.toxicity import op9_toxicity
from quillgate.llm.url_filter import op6_url_filter

QUERIES = {
    "op1_hamming_topk": op1_hamming_topk,
    "op2_minmax_near_dedup": op2_minmax_near_dedup,
    "op3_token_store": op3_token_store,
    "op4_line_dedup": op4_line_dedup,
    "op5_pii": op5_pii,
    "op6_url_filter": op6_url_filter,
    "op7_mixing": op7_mixing,
    "op8_packing": op8_packing,
    "op9_toxicity": op9_toxicity,
    "op10_hnsw_near_dedup": op10_hnsw_near_dedup,
}

ORACLES = {
    "op1_hamming_topk": OP1_SQL,
    "op4_line_dedup": OP4_SQL,
    "op7_mixing": OP7_SQL,
}
