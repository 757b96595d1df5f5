"""Relational operators of the engine: index build, search, filters and facets, updates, evaluation."""
