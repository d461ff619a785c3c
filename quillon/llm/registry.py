"""Queries and DuckDB SQL of the training-data operators."""

from __future__ import annotations

from .bpe import op9_bitmap_queue_bpe
from .class_lm import op2_brown_class_scores
from .decontam import op8_qgram_decontamination
from .html_text import op4_crf_extraction
from .idcodec import op5_mixing_id_files
from .oracles import ORACLE_SQL
from .neardup import op1_adaptive_prefix_join
from .quality import op7_line_first_cleaning
from .sharding import op6_histogram_sort_shards
from .tokens import op10_token_counts
from .toxicity import op3_nnpu_toxicity

QUERIES = {
    "op1_adaptive_prefix_join": op1_adaptive_prefix_join,
    "op2_brown_class_scores": op2_brown_class_scores,
    "op8_qgram_decontamination": op8_qgram_decontamination,
    "op4_crf_extraction": op4_crf_extraction,
    "op3_nnpu_toxicity": op3_nnpu_toxicity,
    "op5_mixing_id_files": op5_mixing_id_files,
    "op7_line_first_cleaning": op7_line_first_cleaning,
    "op6_histogram_sort_shards": op6_histogram_sort_shards,
    "op9_bitmap_queue_bpe": op9_bitmap_queue_bpe,
    "op10_token_counts": op10_token_counts,
}


