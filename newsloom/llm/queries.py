"""The queries of this subpackage and the SQL that DuckDB can run for them, gathered from the operators' modules."""

from __future__ import annotations

from importlib import import_module

#: Operator module and the name of its query.
OPERATORS = [
    ("topk_search", "op1_topk_search"),
    ("html_extract", "op2_html_extract"),
    ("mixing", "op3_mixing"),
    ("simhash", "op4_simhash"),
    ("ann_forest", "op6_ann_forest"),
    ("url_reputation", "op7_url_reputation"),
    ("sharding", "op5_sharding"),
    ("quality_knn", "op8_quality_knn"),
    ("substring", "op9_substring"),
    ("packing", "op10_packing"),
    ("spelling", "op11_spelling"),
    ("archive", "op12_warc"),
    ("manifest", "op13_merkle_manifest"),
]


def queries() -> dict:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for module, name in OPERATORS}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"{__package__}.{module}"), "ORACLE_SQL", None) for module, name in OPERATORS}
    return {name: sql for name, sql in found.items() if sql}
