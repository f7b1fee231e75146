"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import importlib

#: Modules with queries; each may have ORACLE, its queries' SQL.
MODULES = ("simhash", "decontaminate", "toxicity", "quality", "packing", "ogg", "chat", "urls", "warc", "licences", "runs", "spelling", "pieces")


def queries() -> dict:
    found = {}
    for name in MODULES:
        module = importlib.import_module(f"corpusmill.llm.{name}")
        found |= {k: f for k, f in vars(module).items() if k.startswith("op") and callable(f) and k[2].isdigit()}
    return found


def oracle_sql() -> dict[str, str]:
    found = {}
    for name in MODULES:
        found |= getattr(importlib.import_module(f"corpusmill.llm.{name}"), "ORACLE", {})
    return found
