"""A small helper to list queries next to their SQL."""

from __future__ import annotations


class Registry:
    def __init__(self) -> None:
        self.queries: dict = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, oracle: str | None = None):
        def keep(fn):
            self.queries[name] = fn
            if oracle:
                self.oracles[name] = oracle
            return fn

        return keep
