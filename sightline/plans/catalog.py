"""All queries of the library, apart from optional subpackages."""

from . import queries_records, queries_scalar, queries_sources, queries_time  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
