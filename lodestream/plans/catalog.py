"""Every registered query of the engine's own operators, with its SQL oracle where SQL can say it."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
ORACLES: dict = {}

#: Modules that register queries, in the order of the build plan.
MODULES = tuple(f"lodestream.plans.{m}" for m in ("usage", "scalar", "retrieval", "dsl", "state", "documents", "sources", "streams", "surface"))

for _name in MODULES:
    _module = importlib.import_module(_name)
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
