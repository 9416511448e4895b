"""Streaming of the corridor engine."""
