"""Training-data operators: sharding, language ID, similarity joins, search, formatting, tokens and privacy.

Nothing else in the library imports this subpackage.
"""
