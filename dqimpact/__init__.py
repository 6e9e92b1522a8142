"""Measure how errors in a table affect analyses and classifiers, on Spark."""
