"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

#: query and module of each operator
OPERATORS = {
    "op1_url_filters": "op1_urls",
    "op2_quality_rules": "op2_quality",
    "op3_mixing": "op3_mixing",
    "op4_packing": "op4_packing",
    "op5_pii": "op5_pii",
    "op6_ann": "op6_ann",
    "op7_brown_lm": "op7_brown",
    "op8_token_counts": "op8_tokens",
    "op9_simhash": "op9_simhash",
    "op10_language_id": "op10_language",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"thicket.llm.{module}"), name) for name, module in OPERATORS.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(importlib.import_module(f"thicket.llm.{module}"), "ORACLE", None) for name, module in OPERATORS.items()}
    return {name: sql for name, sql in found.items() if sql}
