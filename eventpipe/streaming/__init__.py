"""Structured Streaming: the same DataFrame operators as batch, run with checkpoints."""
