"""Incremental forms of the stateless operators and counts."""
