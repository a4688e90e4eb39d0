"""Queries by name, and SQL for them."""

from __future__ import annotations

from .oracles import ORACLES
from .queries import QUERIES

FLAGSHIP = "graph_json"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
