"""Composite reports and the query catalogue over the test tables."""
