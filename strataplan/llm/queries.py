"""The queries of the training-data operators and their DuckDB counterparts."""

from __future__ import annotations

from .codes import OP13_SQL, op13_vector_codes
from .imatch import op4_fingerprints
from .licenses import OP3_SQL, op3_license_scan
from .mixing import OP9_SQL, op9_mixing
from .neardup_vectors import op1_embedding_near_dedup
from .packing import op2_packing
from .pii import op8_pii
from .quality import op7_quality_classifier
from .simhash import op10_simhash_near_dedup
from .suffix_dedup import op6_suffix_array_dedup
from .topk import OP12_SQL, op12_exact_top_k
from .toxicity import op5_toxicity
from .whitening import op11_whitening

QUERIES = {
    "op1_embedding_near_dedup": op1_embedding_near_dedup,
    "op2_packing": op2_packing,
    "op3_license_scan": op3_license_scan,
    "op4_fingerprints": op4_fingerprints,
    "op5_toxicity": op5_toxicity,
    "op6_suffix_array_dedup": op6_suffix_array_dedup,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_pii": op8_pii,
    "op9_mixing": op9_mixing,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_whitening": op11_whitening,
    "op12_exact_top_k": op12_exact_top_k,
    "op13_vector_codes": op13_vector_codes,
}

ORACLE: dict[str, str] = {
    "op3_license_scan": OP3_SQL,
    "op9_mixing": OP9_SQL,
    "op12_exact_top_k": OP12_SQL,
    "op13_vector_codes": OP13_SQL,
}
