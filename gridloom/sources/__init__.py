"""Sources of the corridor engine."""
