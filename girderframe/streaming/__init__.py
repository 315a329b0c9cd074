"""Time-driven operators, in batch and Structured Streaming form."""
