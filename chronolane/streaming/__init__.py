"""streaming of the recording engine."""
