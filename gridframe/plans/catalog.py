"""All registered queries of the engine, collected from the modules of ``gridframe.plans``."""

from __future__ import annotations

from collections.abc import Callable

from gridframe.plans import fixture_queries, page_queries, review_queries


def _modules() -> list:
    return [page_queries, fixture_queries, review_queries]


def queries() -> dict[str, Callable]:
    out: dict[str, Callable] = {}
    for module in _modules():
        out.update(module.QUERIES)
    return out


def oracles() -> dict[str, str]:
    out: dict[str, str] = {}
    for module in _modules():
        out.update(module.ORACLES)
    return out
