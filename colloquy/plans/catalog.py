"""All registered queries. Importing the modules fills the registry."""

from colloquy.plans import extract_queries, ingest_queries, model_queries, retrieval_queries, stream_queries, table_queries  # noqa: F401
from colloquy.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
