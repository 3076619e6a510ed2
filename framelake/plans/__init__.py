"""Whole plans: containers derived from tables, and the registered queries with their SQL."""
