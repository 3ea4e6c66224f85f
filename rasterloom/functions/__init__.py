"""Part of the rasterloom engine."""
