"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from lodestone.llm.alignment import op13_alignment
from lodestone.llm.ann import op2_nearest_neighbours
from lodestone.llm.bpe import op5_bpe
from lodestone.llm.licenses import op1_license_scans, op1_sql
from lodestone.llm.minmax import op10_minmax_near_dedup, op10_sql
from lodestone.llm.phrases import op3_sql, op3_substring_dedup
from lodestone.llm.pieces import op11_pieces
from lodestone.llm.quality import op8_quality
from lodestone.llm.repair import op12_conversation_repair
from lodestone.llm.sharding import op9_sharding
from lodestone.llm.suffixes import op6_suffix_dedup
from lodestone.llm.tiling import op4_decontamination
from lodestone.llm.toxicity import op7_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scans,
        op2_nearest_neighbours,
        op3_substring_dedup,
        op4_decontamination,
        op5_bpe,
        op6_suffix_dedup,
        op7_toxicity,
        op8_quality,
        op9_sharding,
        op10_minmax_near_dedup,
        op11_pieces,
        op12_conversation_repair,
        op13_alignment,
    )
}
SQL = {"op1_license_scans": op1_sql(), "op3_substring_dedup": op3_sql(), "op10_minmax_near_dedup": op10_sql()}
