"""Sources of the free-space engine."""
