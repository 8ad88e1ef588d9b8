"""Operators for building a training corpus from raw documents."""
