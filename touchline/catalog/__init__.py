"""Registered queries: each runs an operator over whole tables and is paired with equivalent SQL where SQL can say it."""

from touchline.catalog import ingest, metrics, models, priors, sequences, summaries  # noqa: F401
from touchline.catalog.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
