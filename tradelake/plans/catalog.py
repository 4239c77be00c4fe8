"""All registered queries and their oracles."""

from __future__ import annotations

from tradelake.plans import analysis, integrity, market, streams, trading  # noqa: F401
from tradelake.plans.integrity import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
