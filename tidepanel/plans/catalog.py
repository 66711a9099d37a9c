"""All registered queries (importing the catalog modules registers them)."""

from __future__ import annotations

from . import (  # noqa: F401
    catalog_arx,
    catalog_clean,
    catalog_features,
    catalog_gold,
    catalog_models,
    catalog_regression,
)
from .registry import QUERIES, Query


def all_queries() -> dict[str, Query]:
    return dict(QUERIES)
