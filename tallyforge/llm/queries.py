"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

#: Query name -> module; the function has the query's name.
NAMES = {
    "op1_packing": "packing",
    "op2_suffix_dedup": "suffix_dedup",
    "op3_language_id": "language_id",
    "op4_near_dedup": "near_dedup",
    "op5_html_extraction": "html_text",
    "op6_quality": "quality",
    "op7_nearest_neighbours": "nearest",
    "op8_url_filters": "url_filters",
    "op9_sharding": "sharding",
    "op10_decontamination": "decontamination",
    "op11_token_counts": "token_counts",
    "op12_collocations": "collocations",
    "op13_merkle_manifest": "merkle",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"tallyforge.llm.{module}"), name) for name, module in NAMES.items()}


def oracle_sql() -> dict[str, str]:
    from tallyforge.llm import collocations, merkle, url_filters

    return {"op8_url_filters": url_filters.SQL, "op12_collocations": collocations.SQL, "op13_merkle_manifest": merkle.SQL}
