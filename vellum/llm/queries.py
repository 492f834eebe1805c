"""Queries of this subpackage and their SQL."""

import importlib

MODULES = ("q_encoding", "q_packing", "q_survivors", "q_sentences", "q_lookalikes", "q_scans", "q_alignment", "q_languages")

QUERIES, SQL = {}, {}
for _m in MODULES:
    try:
        _x = importlib.import_module(f"vellum.llm.{_m}")
    except ModuleNotFoundError as _e:
        if not str(_e.name).startswith("vellum.llm.q_"):
            raise
        continue
    QUERIES |= _x.QUERIES
    SQL |= _x.SQL
