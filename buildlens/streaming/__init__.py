"""Structured Streaming: the job queue."""
