"""Structured Streaming over the judgement log."""
