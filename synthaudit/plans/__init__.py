"""Composed plans: fixtures, the audit pipeline, the query catalog."""
