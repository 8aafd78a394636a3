"""All registered queries.  Importing the query modules fills the registry."""
from __future__ import annotations

import importlib
import pkgutil

import ballast.plans as plans
from ballast.plans.registry import ORACLES, QUERIES

for _m in sorted(m.name for m in pkgutil.iter_modules(plans.__path__) if m.name.startswith("queries_")):
    importlib.import_module(f"ballast.plans.{_m}")


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)


def flagship(spark, sf):
    return QUERIES["g5_random_oversample_counts"](spark, sf)
