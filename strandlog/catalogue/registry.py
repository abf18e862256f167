"""Where queries register: a name, a function of (spark, sf_dir) and, where SQL can say it, its oracle."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable:
    def add(function: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"registered twice: {name}")
        QUERIES[name] = function
        if oracle:
            ORACLES[name] = oracle
        return function

    return add
