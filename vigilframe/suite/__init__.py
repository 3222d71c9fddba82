"""All registered queries, one module per area."""

from __future__ import annotations

from importlib import import_module

AREAS = ("quality", "history", "evaluation", "registry", "workload", "catalog", "search", "streaming", "scalars", "null_keys", "registry_run")


def load():
    """Import every area once and return (queries, SQL twins)."""
    for area in AREAS:
        import_module(f"vigilframe.suite.{area}")
    from vigilframe.suite.base import ORACLES, QUERIES

    return dict(QUERIES), dict(ORACLES)
