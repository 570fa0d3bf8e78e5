"""The queries and SQL of this package, for ``__spark_entry__``."""

from __future__ import annotations

from textloom.llm.divergence import OP11_SQL, op11_source_divergence
from textloom.llm.fingerprints import op8_fingerprints
from textloom.llm.langid import op7_language_id
from textloom.llm.lines import OP9_SQL, op9_site_lines
from textloom.llm.lmscore import op13_lm_scoring
from textloom.llm.mixing import OP3_SQL, op3_temperature_mixing
from textloom.llm.neardup import op2_dart_minhash
from textloom.llm.neighbours import OP1_SQL, op1_block_matrix_search
from textloom.llm.packing import op5_best_fit_packing
from textloom.llm.sharding import OP4_SQL, op4_stratified_shards
from textloom.llm.suffixes import op6_suffix_passages
from textloom.llm.toxicity import op10_toxicity
from textloom.llm.trie import OP12_SQL, op12_prefix_trie


def queries():
    return {
        "op1_block_matrix_search": op1_block_matrix_search,
        "op2_dart_minhash": op2_dart_minhash,
        "op3_temperature_mixing": op3_temperature_mixing,
        "op4_stratified_shards": op4_stratified_shards,
        "op5_best_fit_packing": op5_best_fit_packing,
        "op6_suffix_passages": op6_suffix_passages,
        "op7_language_id": op7_language_id,
        "op8_fingerprints": op8_fingerprints,
        "op9_site_lines": op9_site_lines,
        "op10_toxicity": op10_toxicity,
        "op11_source_divergence": op11_source_divergence,
        "op12_prefix_trie": op12_prefix_trie,
        "op13_lm_scoring": op13_lm_scoring,
    }


def oracle_sql():
    return {
        "op1_block_matrix_search": OP1_SQL,
        "op3_temperature_mixing": OP3_SQL,
        "op4_stratified_shards": OP4_SQL,
        "op9_site_lines": OP9_SQL,
        "op11_source_divergence": OP11_SQL,
        "op12_prefix_trie": OP12_SQL,
    }
