"""Queries of the training-data operators, and the oracles that SQL can express."""

from __future__ import annotations

from .bpe_round_trip import op10_bpe_round_trip
from .hard_negatives import ORACLE as OP13, op13_hard_negatives
from .licenses import BASE_ORACLE, license_base_columns, op5_license_scan
from .ngram_join import ORACLE as OP6, op6_ngram_jaccard_join
from .packing import op4_best_fit_packing
from .quality_classifier import op8_quality_classifier
from .quality_rules import ORACLE as OP7, op7_quality_rules
from .secret_scan import op1_secret_scan
from .spelling import op11_spelling_variants
from .substring_dedup import ORACLE as OP9, op9_substring_dedup
from .token_count import op2_token_counts
from .vector_search import ORACLE as OP3, op3_exact_top_k
from .window_packing import op12_differencing_packing

QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_token_counts, op3_exact_top_k, op4_best_fit_packing, op5_license_scan, op6_ngram_jaccard_join, op7_quality_rules, op8_quality_classifier, op9_substring_dedup, op10_bpe_round_trip, op11_spelling_variants, op12_differencing_packing, op13_hard_negatives, license_base_columns)}
ORACLES = {"op3_exact_top_k": OP3, "license_base_columns": BASE_ORACLE, "op6_ngram_jaccard_join": OP6, "op7_quality_rules": OP7, "op9_substring_dedup": OP9, "op13_hard_negatives": OP13}
