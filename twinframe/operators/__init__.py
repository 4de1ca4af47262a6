"""Relational building blocks: profile, moments, ECDF, frequencies, neighbours."""
