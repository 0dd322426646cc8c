"""Functions of the free-space engine."""
