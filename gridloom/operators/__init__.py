"""Operators of the corridor engine."""
