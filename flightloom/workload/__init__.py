"""The registered queries and the SQL that checks them."""

from __future__ import annotations

import functools
import importlib

from ..session import tune

MODULES = ("tracks", "calendars", "reports", "tables", "encoding", "statistics", "shapes", "exposures", "models", "features", "files", "split")


def _tuned(fn):
    @functools.wraps(fn)
    def run(spark, sf_dir):
        return fn(tune(spark), sf_dir)

    return run


def _collect(part: str) -> dict:
    out = {}
    for name in MODULES:
        out.update(getattr(importlib.import_module(f"{__name__}.{name}").REGISTRY, part))
    return out


def all_queries() -> dict:
    return {name: _tuned(fn) for name, fn in _collect("queries").items()}


def all_oracles() -> dict:
    return _collect("oracles")
