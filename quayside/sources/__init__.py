"""sources of the quayside engine."""
