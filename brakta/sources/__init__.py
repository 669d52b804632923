"""Readers, writers and adapters at the edge of the engine."""
