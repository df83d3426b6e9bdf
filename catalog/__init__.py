"""The registered queries: each runs an operator over whole given tables; most have an
equivalent SQL text that an independent engine can run on the same tables."""

from .base import QUERIES, SQL
from . import cleaning, encoding, flows, forecasts, metrics, modelling, profiling, series, textual  # noqa: F401

__all__ = ["QUERIES", "SQL"]
