"""All registered queries."""

from __future__ import annotations

import importlib
import pkgutil

from brierworks import plans
from brierworks.plans.registry import ORACLES, QUERIES

for _m in sorted(m.name for m in pkgutil.iter_modules(plans.__path__) if m.name.endswith("_queries")):
    importlib.import_module(f"brierworks.plans.{_m}")

__all__ = ["ORACLES", "QUERIES"]
