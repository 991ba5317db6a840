"""Operators on arrays laid out as cells (a row per element) or chunks (a row per tile)."""
