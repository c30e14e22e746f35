"""Operators on signals that stand outside a query language."""
