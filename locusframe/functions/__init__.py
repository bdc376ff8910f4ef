"""Column expressions on genotypes, sequences, distances and trees."""
