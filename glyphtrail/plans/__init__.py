"""All registered queries of the library."""

from . import attribution_queries, corpus_queries, emission_queries, stream_queries, text_queries, validation_queries  # noqa: F401
from .registry import REGISTRY

__all__ = ["REGISTRY"]
