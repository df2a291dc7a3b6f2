"""Structured Streaming forms of the job lifecycle."""
