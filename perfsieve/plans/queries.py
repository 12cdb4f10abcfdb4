"""Everything registered, in one place."""

from __future__ import annotations

import importlib

from perfsieve.plans.registry import CHECKS, QUERIES, Query

_MODULES = [
    "summary_queries",
    "feature_queries",
    "order_queries",
    "text_queries",
    "series_queries",
    "model_queries",
]
for _module in _MODULES:
    importlib.import_module(f"perfsieve.plans.{_module}")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(CHECKS)
