"""Synthetic tables by smoothed bootstrap, and fidelity reports between two tables, on Spark."""
