"""Structured Streaming over a drop folder."""
