"""Every operator as a named query over the given tables, with its SQL check."""

from __future__ import annotations

from fitgrain.catalog.registry import ORACLES, QUERIES
from fitgrain.catalog import cleaning, evaluation, exploration, features, models, retrieval, sources  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
