"""The registered queries of the signal operators and their SQL."""

from __future__ import annotations

from tracemill.plans.base import ORACLE_SQL, QUERIES
from tracemill.plans import borders, compositions, io, metrics, polish, segmentation, lattice, sequences, series  # noqa: F401  (they register themselves)

__all__ = ["ORACLE_SQL", "QUERIES"]
