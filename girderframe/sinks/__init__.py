"""Frames shaped for output and the writers that store them."""
