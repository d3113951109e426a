"""The registered queries, one module a group."""

from brindle.plans.queries import boxes, contracts, metrics, pairs, retrieval, scans, spans, text  # noqa: F401
