"""Composite jobs chained from the operators."""
