"""All registered queries with their comparison SQL."""

from __future__ import annotations

from . import (  # noqa: F401
    catalog_evidence,
    catalog_graph,
    catalog_knowledge,
    catalog_records,
    catalog_retrieval,
    catalog_sources,
)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
