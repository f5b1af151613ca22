"""Registered queries and their SQL."""

from . import lookups as _lookups  # registers its queries
from . import shapes as _shapes
from .queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
