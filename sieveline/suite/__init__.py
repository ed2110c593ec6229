"""All registered queries over the given tables."""

from __future__ import annotations

import importlib
import pkgutil


def _load() -> None:
    for module in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        if module.startswith("q_"):
            importlib.import_module(f"{__name__}.{module}")


def queries():
    from sieveline.suite.registry import QUERIES

    _load()
    return dict(QUERIES)


def oracle_sql():
    from sieveline.suite.registry import check_sql

    _load()
    return check_sql()
