"""Genotype views over the given tables, and the queries that run on them."""
