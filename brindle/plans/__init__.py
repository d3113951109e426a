"""Composed pipelines, the query registry and lineage control."""
