"""Streaming of the free-space engine."""
