"""The driver's queries, grouped by what they exercise."""

from stellwerk.checks import boards, flow, scalars  # noqa: F401
from stellwerk.checks.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
