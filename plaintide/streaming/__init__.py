"""Structured Streaming: the live pool, sessions, deduplication, catch-up."""
