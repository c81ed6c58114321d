"""Shared passes over the table, and the assembly of findings."""
