"""All queries of the training-data operators (``QUERIES``) and their DuckDB SQL (``ORACLES``)."""

from clinloom.llm import (  # noqa: F401
    op2_best_fit_packing,
    op1_pruned_graph_ann,
    op3_url_filters,
    op4_wavelet_tokens,
    op5_word_first_langid,
    op6_toxicity_mil,
    op7_substring_dedup,
    op8_spaced_seeds,
    op9_brown_lm,
    op10_jaccard_join,
    op11_collocations,
    op12_filter_audit,
    op13_suffix_dedup,
)
from clinloom.llm.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
