"""All queries of the subpackage.  Importing the query modules fills the registry."""
from __future__ import annotations

import importlib
import pkgutil

import ballast.llm as package
from ballast.llm.registry import ORACLES, QUERIES

for _m in sorted(m.name for m in pkgutil.iter_modules(package.__path__) if m.name.startswith("queries_")):
    importlib.import_module(f"ballast.llm.{_m}")


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
