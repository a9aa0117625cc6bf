"""The registered queries and the SQL that checks them."""

from __future__ import annotations

import importlib

_MODULES = ["dialogue", "timeline", "alignment", "scripts", "marks", "assets", "documents", "requests", "audio", "jobs"]


def _modules():
    for name in _MODULES:
        yield importlib.import_module(f"cuesheet.registry.{name}")


def all_queries():
    found = {}
    for module in _modules():
        found.update(module.QUERIES)
    return found


def all_oracles():
    found = {}
    for module in _modules():
        found.update(module.ORACLE)
    return found
