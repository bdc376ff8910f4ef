"""Filters, statistics, comparisons and exports of genotype tables.

Long form: `calls`, one row per called genotype (site_id, locus, pos, sample_idx, sample, pop, a1,
a2, dosage, dp); a missing call is an absent row. Packed form: one row per site, with `calls`, an
array of struct(gt, dp) in the order of the samples.
"""
