"""The registered training-data queries and their SQL."""

from __future__ import annotations

import corpus_pipeline

from .embeddings import op8_embeddings
from .minhash import op2_minhash
from .mixing import OP10_SQL, op10_mixing
from .oracles import OP2_SQL, OP5_SQL, OP8_SQL
from .packing import op4_packing
from .pii import op1_pii
from .quality import op9_quality
from .recompression import op5_recompression
from .suffix_tree import op3_suffix_tree
from .toxicity import op6_toxicity
from .urls import op7_urls

QUERIES = {
    "op1_pii": op1_pii,
    "op2_minhash": op2_minhash,
    "op3_suffix_tree": op3_suffix_tree,
    "op4_packing": op4_packing,
    "op5_recompression": op5_recompression,
    "op6_toxicity": op6_toxicity,
    "op7_urls": op7_urls,
    "op8_embeddings": op8_embeddings,
    "op9_quality": op9_quality,
    "op10_mixing": op10_mixing,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL: dict[str, str] = {"op2_minhash": OP2_SQL, "op5_recompression": OP5_SQL, "op8_embeddings": OP8_SQL, "op10_mixing": OP10_SQL}
