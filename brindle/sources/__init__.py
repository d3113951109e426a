"""Readers, writers and sidecar files."""
