"""Registry of the reliability queries and their SQL."""

from . import agreement, inference, rankings, relational, values  # noqa: F401  they register themselves
from .tables import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
