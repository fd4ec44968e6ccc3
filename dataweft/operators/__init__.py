"""Operators, one module per area."""
