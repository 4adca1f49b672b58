"""All registered queries."""

from . import annotations, cleaning, files, models, pages, review, scoring, streams, tasks, training  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
