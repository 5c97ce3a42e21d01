"""Queries that prepare what plots show, and whole analyses made of operators."""
