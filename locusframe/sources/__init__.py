"""Readers and writers of VCF, sequence and table files."""
