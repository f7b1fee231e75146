"""All queries of the library with their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

#: Modules with QUERIES (name -> f(spark, sf_dir)) and ORACLE (name -> SQL).
MODULES = ("plans.ingest", "plans.queue", "plans.knowledge", "plans.records", "plans.files", "plans.stores", "plans.exports", "plans.forms", "streaming.events")
FLAGSHIP = "hybrid_search"


def queries() -> dict[str, Callable]:
    found = {}
    for name in MODULES:
        found |= importlib.import_module(f"corpusmill.{name}").QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found = {}
    for name in MODULES:
        found |= importlib.import_module(f"corpusmill.{name}").ORACLE
    return found
