"""Ready-made queries over the given tables."""

from __future__ import annotations

from importlib import import_module

from textveil.plans.registry import ORACLES, QUERIES

_MODULES = ("privacy", "labels", "curation", "evaluation", "training", "streams")


def _load() -> None:
    for name in _MODULES:
        import_module(f"textveil.plans.{name}")


def all_queries() -> dict:
    _load()
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    _load()
    return dict(ORACLES)
