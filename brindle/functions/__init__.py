"""Typed functions, operators and casts as column expressions."""
