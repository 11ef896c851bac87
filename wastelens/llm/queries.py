"""Registered queries of the subpackage and their DuckDB oracle texts."""

from __future__ import annotations

from wastelens.llm.alignment import op12_alignment
from wastelens.llm.decontaminate import op7_decontaminate
from wastelens.llm.hard_negatives import OP13_SQL, op13_hard_negatives
from wastelens.llm.packing import op6_packing
from wastelens.llm.quality_model import op2_quality
from wastelens.llm.quality_rules import op8_quality_rules
from wastelens.llm.sharding import op5_sharding
from wastelens.llm.simhash import op4_simhash
from wastelens.llm.suffixes import op9_suffix_dedup
from wastelens.llm.token_counts import op11_token_counts
from wastelens.llm.tool_calls import OP10_SQL, op10_tool_calls
from wastelens.llm.toxicity import op1_toxicity
from wastelens.llm.url_templates import op3_url_templates

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_quality": op2_quality,
    "op3_url_templates": op3_url_templates,
    "op4_simhash": op4_simhash,
    "op5_sharding": op5_sharding,
    "op6_packing": op6_packing,
    "op7_decontaminate": op7_decontaminate,
    "op8_quality_rules": op8_quality_rules,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_tool_calls": op10_tool_calls,
    "op11_token_counts": op11_token_counts,
    "op12_alignment": op12_alignment,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE = {"op10_tool_calls": OP10_SQL, "op13_hard_negatives": OP13_SQL}
