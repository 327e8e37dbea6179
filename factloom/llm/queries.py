"""Queries of the operators of this subpackage: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import corpus_pipeline

from factloom.llm.conversations import OP11_SQL, op11_conversation_repair
from factloom.llm.decontamination import op6_decontamination
from factloom.llm.fingerprints import op7_fingerprints
from factloom.llm.languages import op9_language_id
from factloom.llm.lines import OP8_SQL, op8_line_dedup
from factloom.llm.near import OP3_SQL, op3_near_dedup
from factloom.llm.packing import op1_packing
from factloom.llm.passages import op2_passage_dedup
from factloom.llm.sentencepieces import op12_sentencepiece
from factloom.llm.sharding import op10_sharding
from factloom.llm.spellings import OP13_SQL, op13_spelling_variants
from factloom.llm.suffix_tree import op4_lm_scoring
from factloom.llm.suffixes import op5_suffix_dedup

QUERIES = {
    "op1_packing": op1_packing,
    "op2_passage_dedup": op2_passage_dedup,
    "op3_near_dedup": op3_near_dedup,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_decontamination": op6_decontamination,
    "op7_fingerprints": op7_fingerprints,
    "op8_line_dedup": op8_line_dedup,
    "op9_language_id": op9_language_id,
    "op10_sharding": op10_sharding,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_sentencepiece": op12_sentencepiece,
    "op13_spelling_variants": op13_spelling_variants,
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict[str, str] = {"op3_near_dedup": OP3_SQL, "op8_line_dedup": OP8_SQL, "op11_conversation_repair": OP11_SQL, "op13_spelling_variants": OP13_SQL}
