"""Registered queries over the driver's tables."""

from tessera.plans import corpus_queries, result_queries, selection_queries, source_queries, stream_queries, task_queries  # noqa: F401
