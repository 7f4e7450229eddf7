"""Queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from importlib import import_module

from . import collocations

#: name: module of the query function of the same name.
MODULES = {
    "op1_nearest_neighbours": "ann",
    "op2_toxicity": "toxicity",
    "op3_best_fit_packing": "packing",
    "op4_html_extraction": "html_text",
    "op5_quality": "quality",
    "op6_language_id": "language_id",
    "op7_benchmark_decontamination": "decontaminate",
    "op8_simhash_near_dedup": "simhash",
    "op9_suffix_array_dedup": "substring_dedup",
    "op10_token_store": "token_store",
    "op11_phrase_collocations": "collocations",
    "op12_embedding_whitening": "whitening",
    "op13_consistent_sharding": "sharding",
}

QUERIES = {name: getattr(import_module(f".{module}", __package__), name) for name, module in MODULES.items()}

ORACLES: dict[str, str] = {"op11_phrase_collocations": collocations.SQL}
