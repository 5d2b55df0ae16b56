"""plans of the recording engine."""
