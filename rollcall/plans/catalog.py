"""All registered queries."""

from . import checks, contributions, exits, funds, hierarchies, panels, record_checks, reforms, risks, scores, series, texts  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
