"""Operators for the text of training-data pipelines; nothing outside imports this subpackage."""
