"""Column-level functions: each takes and returns Spark columns."""
