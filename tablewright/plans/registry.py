"""Name -> query and name -> DuckDB SQL, gathered from the modules of this folder."""

from __future__ import annotations

from tablewright.plans import banking, boxing, choosing, controls, extras, fieldtables, grids, ledgers, paging, parsing, revenue, rollups, scalar, scores, selections, stewarding, variants  # noqa: F401
from tablewright.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
