"""Relational operators: selections, joins, peaks, windows, profiles and sheets."""
