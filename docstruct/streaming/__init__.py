"""Structured Streaming: incremental forms and images."""
