"""Structured Streaming forms of the embedding, caching and latency jobs."""
