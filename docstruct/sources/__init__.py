"""Readers of landed responses and sinks for results."""
