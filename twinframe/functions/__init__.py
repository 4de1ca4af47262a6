"""Column functions: cell typing, rounding, seeded randomness, distributions."""
