"""operators of the recording engine."""
