"""Query keys of this subpackage: key -> Spark function, and key -> oracle SQL."""

from __future__ import annotations

from .knn_join import ORACLE as KNN_SQL
from .knn_join import op1_knn_join
from .language_id import op7_language_id
from .line_dedup import ORACLE as LINE_DEDUP_SQL
from .line_dedup import op2_line_dedup
from .near_duplicates import op5_near_duplicates
from .packing import op8_packing
from .quality_model import op6_quality_model
from .quality_rules import ORACLE as QUALITY_RULES_SQL
from .quality_rules import op9_quality_rules
from .resampling import ORACLE as IMPORTANCE_SQL
from .resampling import op11_importance
from .sort_means import ORACLE as SORT_MEANS_SQL
from .sort_means import op12_sort_means
from .source_mix import op10_source_mix
from .token_counts import op4_token_counts
from .toxicity import op3_toxicity
from .url_cascade import ORACLE as URL_RULES_SQL
from .url_cascade import op13_url_rules

QUERIES = {
    "op1_knn_join": op1_knn_join,
    "op2_line_dedup": op2_line_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_token_counts": op4_token_counts,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_quality_model": op6_quality_model,
    "op7_language_id": op7_language_id,
    "op8_packing": op8_packing,
    "op9_quality_rules": op9_quality_rules,
    "op10_source_mix": op10_source_mix,
    "op11_importance": op11_importance,
    "op12_sort_means": op12_sort_means,
    "op13_url_rules": op13_url_rules,
}
ORACLES = {
    "op1_knn_join": KNN_SQL,
    "op2_line_dedup": LINE_DEDUP_SQL,
    "op9_quality_rules": QUALITY_RULES_SQL,
    "op11_importance": IMPORTANCE_SQL,
    "op12_sort_means": SORT_MEANS_SQL,
    "op13_url_rules": URL_RULES_SQL,
}
