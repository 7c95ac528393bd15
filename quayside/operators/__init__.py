"""operators of the quayside engine."""
