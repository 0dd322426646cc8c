"""Operators of the free-space engine."""
