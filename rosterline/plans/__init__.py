"""End-to-end plans, and the catalogue of queries on the given tables."""
