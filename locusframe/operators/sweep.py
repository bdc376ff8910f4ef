"""Sweeps of an assembly parameter: one table with `param` in every key, no loop over files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sides import small_side
from .pairs import allele_set_distance
from .replicates import replicate_errors
from .stats import dataset_size, snp_heterozygosity, summary


def tagged(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """Tables of several parameter values as one, tagged by `param`."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("param", F.lit(p)) for p, df in parts])


def box_summary(df: DataFrame, column: str) -> DataFrame:
    """Five numbers and the mean of a metric, by parameter."""
    return summary(df, column, "param")


def loci_80(calls: DataFrame, samples: DataFrame, share: float = 0.8) -> DataFrame:
    """Loci with a varying SNP called in a share of the samples, by parameter."""
    n = samples.agg(F.count(F.lit(1)).alias("size"))
    site = calls.groupBy("param", "site_id", "locus").agg(F.count(F.lit(1)).alias("n"), F.min("dosage").alias("lo"), F.max("dosage").alias("hi"))
    return site.crossJoin(F.broadcast(n)).where((F.col("lo") != F.col("hi")) & (F.col("n") >= share * F.col("size"))).groupBy("param").agg(F.countDistinct("locus").alias("loci80"))


def optimise(calls: DataFrame, samples: DataFrame, reps: DataFrame) -> DataFrame:
    """Per parameter: size, loci in 80 %, mean heterozygosity, mean distance within populations.

    `calls` carries `param`. The second member of each replicate pair is left out of all of it.
    """
    own = calls.join(small_side(reps.select(F.col("sample_b").alias("sample"))), "sample", "left_anti")
    left = samples.join(small_side(reps.select(F.col("sample_b").alias("sample"))), "sample", "left_anti")
    size = dataset_size(own, "param")
    het = snp_heterozygosity(own, "param").groupBy("param").agg(F.avg("het").alias("mean_het"))
    pop = left.select("sample", "pop")
    d = allele_set_distance(own, "param")
    d = d.join(small_side(pop.withColumnsRenamed({"sample": "a", "pop": "pa"})), "a").join(small_side(pop.withColumnsRenamed({"sample": "b", "pop": "pb"})), "b")
    within = d.where("pa = pb").groupBy("param").agg(F.avg("dist").alias("mean_within"))
    return size.join(loci_80(own, left), "param", "left").join(het, "param").join(within, "param", "left").select("param", "loci", "snps", F.coalesce("loci80", F.lit(0)).alias("loci80"), "mean_het", "mean_within")


def errors_by_param(calls: DataFrame, reps: DataFrame) -> DataFrame:
    """Replicate errors of each parameter value: `param` is one more key, all values at once."""
    return replicate_errors(calls, reps, "param")


def optimise_table(calls: DataFrame, seqs: DataFrame, samples: DataFrame, reps: DataFrame, share: float = 0.8, min_samples: int = 5) -> DataFrame:
    """One row per parameter value with all figures of a sweep, parameters being one more key, not a loop.

    `calls` and `seqs` (param, locus, sample, seq) carry `param`. Errors are means over the replicate pairs; after them
    the second member of each pair is left out. loci80: loci with a varying SNP called in `share` of the samples;
    loci80_pop: the mean over populations of `min_samples` samples or more of the same within each. snp_het
    and seq_het: mean share of heterozygous SNPs, and of ambiguity codes, over samples. mean_within and mean_between:
    GENPOFAD of pairs of one population and of two; the sums of all values come from one pass over the sites. A figure
    that nothing gives is null, counts are 0.
    """
    second = small_side(reps.select(F.col("sample_b").alias("sample")))  # one row for each pair
    own, left, text = (df.join(second, "sample", "left_anti") for df in (calls, samples, seqs))
    errors = errors_by_param(calls, reps).groupBy("param").agg(*[F.avg(c).alias(c) for c in ("locus_error", "allele_error", "snp_error")])
    het = snp_heterozygosity(own, "param").groupBy("param").agg(F.avg("het").alias("snp_het"))
    low = F.lower("seq")
    codes, known = F.length(F.regexp_replace(low, "[^kmrswybdhv]", "")), F.length(F.regexp_replace(low, "[?n-]", ""))
    seq = text.groupBy("param", "sample").agg((F.sum(codes) / F.nullif(F.sum(known), F.lit(0))).alias("h")).groupBy("param").agg(F.avg("h").alias("seq_het"))
    size = left.where("pop is not null").groupBy("pop").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= min_samples)
    site = own.join(small_side(left.select("sample")), "sample", "left_semi").groupBy("param", "pop", "site_id", "locus").agg(F.count(F.lit(1)).alias("n"), F.min("dosage").alias("lo"), F.max("dosage").alias("hi"))
    good = site.join(small_side(size), "pop").where((F.col("lo") != F.col("hi")) & (F.col("n") >= share * F.col("size")))
    by_pop = own.select("param").distinct().crossJoin(small_side(size.select("pop"))).join(good.groupBy("param", "pop").agg(F.countDistinct("locus").alias("l")), ["param", "pop"], "left")
    by_pop = by_pop.groupBy("param").agg(F.avg(F.coalesce("l", F.lit(0))).alias("loci80_pop"))
    pop = left.select("sample", "pop")
    d = allele_set_distance(own, "param")
    d = d.join(small_side(pop.withColumnsRenamed({"sample": "a", "pop": "pa"})), "a").join(small_side(pop.withColumnsRenamed({"sample": "b", "pop": "pb"})), "b")
    dist = d.groupBy("param").agg(F.avg(F.when(F.col("pa") == F.col("pb"), F.col("dist"))).alias("mean_within"), F.avg(F.when(F.col("pa") != F.col("pb"), F.col("dist"))).alias("mean_between"))
    out = dataset_size(own, "param").drop("samples")
    for part in (loci_80(own, left, share), by_pop, errors, het, seq, dist):
        out = out.join(part, "param", "left")
    return out.withColumn("loci80", F.coalesce("loci80", F.lit(0)))
