"""Plans of the corridor engine."""
