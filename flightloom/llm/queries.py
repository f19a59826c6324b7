"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import functools
import importlib

from ..session import tune

MODULES = ("exact_dedup", "near_dedup", "top_k", "bpe", "secrets", "pii", "toxicity", "packing", "substrings", "lm_scoring", "runs", "repair", "warc")


def _tuned(fn):
    @functools.wraps(fn)
    def run(spark, sf_dir):
        return fn(tune(spark), sf_dir)

    return run


def _registries():
    return [importlib.import_module(f"{__package__}.{name}").REGISTRY for name in MODULES]


def llm_queries() -> dict:
    return {name: _tuned(fn) for r in _registries() for name, fn in r.queries.items()}


def llm_oracles() -> dict:
    return {name: sql for r in _registries() for name, sql in r.oracles.items()}
