"""Plans of the free-space engine."""
