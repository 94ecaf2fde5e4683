"""Queries over the driver tables, composed from the operators."""
