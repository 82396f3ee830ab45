"""Readers, the triple store and release sinks."""
