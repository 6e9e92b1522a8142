"""Whole studies built from the operators: sweeps, EPC, warehouse."""
