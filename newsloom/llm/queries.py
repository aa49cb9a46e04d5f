"""All queries of the subpackage. A module whose own requirements are missing is left out; the others stay."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
SQL: dict = {}
MISSING: dict[str, str] = {}
for _name in ("sentences", "truncation", "spans", "repetition", "tokens", "packing", "residue"):
    try:
        _m = importlib.import_module(f"newsloom.llm.{_name}")
    except ImportError as e:
        MISSING[_name] = str(e)
        continue
    QUERIES.update(_m.QUERIES)
    SQL.update(getattr(_m, "SQL", {}))
