"""streaming of the quayside engine."""
