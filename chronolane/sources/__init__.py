"""sources of the recording engine."""
