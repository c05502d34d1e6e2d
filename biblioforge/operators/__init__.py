"""Relational and semi-structured operators."""
