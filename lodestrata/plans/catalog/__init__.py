"""Queries and their SQL oracles, by family."""

from . import extend, graph, ingest, logs, match, mine, retrieve, rules, store, streams, text, views  # noqa: F401
