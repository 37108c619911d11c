"""Queries over the driver's tables, each with SQL that says the same."""
