"""Queries over the given tables, one per operator, each with a SQL twin where SQL can say the same."""

from __future__ import annotations

from importlib import import_module

from workload.base import ORACLES, QUERIES

_MODULES = ["retrieval", "corpus", "questions", "records"]


def all_queries():
    for name in _MODULES:
        import_module(f"workload.{name}")
    return dict(QUERIES)


def all_oracles():
    all_queries()
    return dict(ORACLES)
