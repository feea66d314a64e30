"""Structured Streaming and stateful jobs."""
