"""The queries of the training-data operators."""

from __future__ import annotations

from .ann import op3_nearest
from .embedding_dedup import op6_embedding_dedup
from .language_id import op2_language_id
from .lm_scoring import op1_lm_scoring
from .minhash_dedup import op4_minhash_dedup
from .mixing import op5_mixing
from .packing import op10_packing
from .token_counts import op9_token_counts
from .token_files import op7_token_files
from .toxicity import op8_toxicity

QUERIES = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_language_id": op2_language_id,
    "op3_nearest": op3_nearest,
    "op4_minhash_dedup": op4_minhash_dedup,
    "op5_mixing": op5_mixing,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_token_files": op7_token_files,
    "op8_toxicity": op8_toxicity,
    "op9_token_counts": op9_token_counts,
    "op10_packing": op10_packing,
}

#: SQL expresses none of them: fitted models, sketches, tokenizers or random rounding.
ORACLES: dict[str, str] = {}
