"""Readers, contracts and sinks."""
