"""Whole plans: fixture views over the test tables and the registered queries of the matcher."""
