"""All registered queries and their SQL."""

from __future__ import annotations

from .plans import batches, boxes, cuts, fields, jobs, modes, nodes, reports, solids, splines, variants  # noqa: F401  (they register their queries)
from .plans.registry import ORACLES, QUERIES  # noqa: F401
