"""Spark jobs for large genotype tables (samples x SNP sites)."""
