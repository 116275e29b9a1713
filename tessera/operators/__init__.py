"""Operators: spatial joins, indexes, aggregates, orderings and checks."""
