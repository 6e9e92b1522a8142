"""Readers and writers for tables, experiment configs and results."""
