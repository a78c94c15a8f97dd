"""Structured Streaming jobs; the same transformations also run on batches."""
