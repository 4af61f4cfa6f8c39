"""Scalar and array expressions, and helpers."""
