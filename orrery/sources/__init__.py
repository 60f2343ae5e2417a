"""Readers of tables, source trees, rules and repository history."""
