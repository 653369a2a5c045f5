"""All registered queries of the library and their DuckDB twins."""

from .plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
