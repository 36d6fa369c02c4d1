"""Every operator bound to the driver's tables, with an equivalent SQL text
where one exists."""

from .registry import ORACLES, QUERIES
from . import aggregates, joins, models, reads, rows, samples  # noqa: F401  (registration)

__all__ = ["ORACLES", "QUERIES"]
