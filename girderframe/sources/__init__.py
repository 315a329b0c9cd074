"""Readers, rule tables and the views over the test tables."""
