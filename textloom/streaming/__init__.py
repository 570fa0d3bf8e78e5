"""Incremental and streaming upkeep of relations."""
