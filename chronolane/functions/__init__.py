"""functions of the recording engine."""
