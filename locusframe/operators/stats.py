"""Statistics of sites, samples and loci over long calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.sides import small_side
from .select import quantiles, smallest


def call_stats(calls: DataFrame) -> DataFrame:
    """Per site: n_called, n_alt and freq_hets, by one aggregation of the long form."""
    return calls.groupBy("site_id").agg(F.count(F.lit(1)).alias("n_called"), F.sum("dosage").alias("n_alt"), F.avg((F.col("dosage") == 1).cast("double")).alias("freq_hets"))


def sample_missing(calls: DataFrame, samples: DataFrame) -> DataFrame:
    """Per sample: percentage of the table's sites that are missing."""
    total = calls.agg(F.countDistinct("site_id").alias("t"))
    have = calls.groupBy("sample").agg(F.count(F.lit(1)).alias("n"))
    return samples.select("sample", "pop").join(have, "sample", "left").crossJoin(F.broadcast(total)).select("sample", "pop", (100 * (1 - F.coalesce("n", F.lit(0)) / F.col("t"))).alias("missing_percent"))


def summary(df: DataFrame, column: str, *by: str) -> DataFrame:
    """min, q1, median, mean, q3, max of a column; quartiles by counting ranges, so no task holds a group's values."""
    ends = df.groupBy(*by).agg(F.min(column).alias("min"), F.avg(column).alias("mean"), F.max(column).alias("max"))
    q = quantiles(df, column, by, (0.25, 0.5, 0.75)).select(*[F.col(c).alias(f"_{c}") for c in by], "q")
    got = ends.join(q, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by] or F.lit(True), "left")
    return got.select(*by, "min", *[F.get("q", F.lit(i)).alias(c) for i, c in enumerate(("q1", "median"))], "mean", F.get("q", F.lit(2)).alias("q3"), "max")


def site_missing(calls: DataFrame, n_samples: int) -> DataFrame:
    """Per site: share of samples missing, and mean depth of the called ones."""
    return calls.groupBy("site_id").agg((1 - F.count(F.lit(1)) / F.lit(n_samples)).alias("f_miss"), F.avg("dp").alias("mean_depth"))


def sample_depth(calls: DataFrame) -> DataFrame:
    return calls.groupBy("sample").agg(F.count(F.lit(1)).alias("n_sites"), F.avg("dp").alias("mean_depth"))


def inbreeding_f(calls: DataFrame) -> DataFrame:
    """Per sample F = (O - E) / (N - E) of homozygous calls, as published for vcftools --het.

    E of a site with n calls and ALT frequency p: 1 - 2 p (1 - p) 2n / (2n - 1). Sites without
    variation are left out; F is null where N = E.
    """
    site = calls.groupBy("site_id").agg(F.count(F.lit(1)).alias("n"), (F.sum("dosage") / (2 * F.count(F.lit(1)))).alias("p")).where("p > 0 and p < 1")
    e = 1 - 2 * F.col("p") * (1 - F.col("p")) * 2 * F.col("n") / (2 * F.col("n") - 1)
    got = calls.join(site.select("site_id", e.alias("e")), "site_id").groupBy("sample").agg(F.count_if(F.col("dosage") != 1).alias("o_hom"), F.sum("e").alias("e_hom"), F.count(F.lit(1)).alias("n"))
    return got.withColumn("f", F.when(F.col("n") != F.col("e_hom"), (F.col("o_hom") - F.col("e_hom")) / (F.col("n") - F.col("e_hom"))))


def depth_by_sample(calls: DataFrame) -> DataFrame:
    """Per sample: mean of the depths above zero."""
    return calls.where("dp > 0").groupBy("sample").agg(F.avg("dp").alias("mean_depth"))


def depth_report(calls: DataFrame) -> DataFrame:
    """One row: sites with depth, overall mean, sample stdev, least and greatest of the site means.

    A site's mean is that of its depths above zero, rounded to an even number at halves.
    """
    site = calls.groupBy("site_id").agg(F.avg(F.when(F.col("dp") > 0, F.col("dp"))).alias("m"), F.max("dp").alias("most"))
    got = site.withColumn("r", F.bround("m", 0))
    return got.agg(
        F.count("m").alias("sites_with_depth"), F.count_if(F.col("m").isNull()).alias("sites_without"), F.avg("m").alias("mean"), F.stddev_samp("m").alias("sd"),
        F.min("m").alias("least"), F.max("m").alias("greatest"), F.max("most").alias("max_depth"), F.sum("r").alias("rounded_total"),
    )


def depth_histogram(calls: DataFrame, most: int, width: float = 5.0) -> DataFrame:
    """Counts of site mean depths in about `width`-wide bins on [0, min(greatest, most)].

    Means above the range are dropped; the last bin is closed.
    """
    site = calls.groupBy("site_id").agg(F.avg(F.when(F.col("dp") > 0, F.col("dp"))).alias("m")).where("m is not null")
    top = site.agg(F.least(F.max("m"), F.lit(float(most))).alias("top"))
    bins = max(1, round(most / width))
    step = F.col("top") / bins
    return site.crossJoin(F.broadcast(top)).where("m <= top").groupBy(F.least(F.floor(F.col("m") / step), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def coverage_counts(calls: DataFrame, n_samples: int, share: float = 0.8) -> DataFrame:
    """One row: SNPs and loci called in at least a share of the samples."""
    site = calls.groupBy("site_id", "locus").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= share * n_samples)
    return site.agg(F.count(F.lit(1)).alias("snps"), F.countDistinct("locus").alias("loci"))


def paris80(calls: DataFrame, samples: DataFrame, by_pop: bool = False, share: float = 0.8, min_samples: int = 5) -> DataFrame:
    """Loci with a SNP that varies (two dosages) and is called in `share` of the samples.

    By population: only populations of `min_samples` samples or more.
    """
    keys = ["pop"] if by_pop else []
    size = samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"))
    if by_pop:
        size = size.where(F.col("size") >= min_samples)
    have = calls.join(small_side(samples.select("sample")), "sample", "left_semi").groupBy("site_id", "locus", *keys).agg(F.count(F.lit(1)).alias("n"), F.min("dosage").alias("lo"), F.max("dosage").alias("hi"))
    have = have.join(small_side(size), keys) if by_pop else have.crossJoin(F.broadcast(size))
    return have.where((F.col("lo") != F.col("hi")) & (F.col("n") >= share * F.col("size"))).groupBy(*keys).agg(F.countDistinct("locus").alias("loci"))


def snp_heterozygosity(calls: DataFrame, *by: str) -> DataFrame:
    """Share of heterozygous calls, by sample and further columns."""
    return calls.groupBy(*by, "sample").agg(F.avg((F.col("dosage") == 1).cast("double")).alias("het"))


def sequence_heterozygosity(seqs: DataFrame) -> DataFrame:
    """Per sample: ambiguity codes among the positions that are not missing; no explode."""
    low = F.lower("seq")
    codes, known = F.length(F.regexp_replace(low, "[^kmrswybdhv]", "")), F.length(F.regexp_replace(low, "[?n-]", ""))
    return seqs.groupBy("sample").agg((F.sum(codes) / F.nullif(F.sum(known), F.lit(0))).alias("het"))


def secondaries_report(calls: DataFrame) -> DataFrame:
    """Number of loci by number of SNPs per locus."""
    return calls.select("locus", "site_id").distinct().groupBy("locus").agg(F.count(F.lit(1)).alias("snps")).groupBy("snps").agg(F.count(F.lit(1)).alias("loci"))


def secondaries_summary(calls: DataFrame, sites: DataFrame) -> DataFrame:
    """One row: loci, those of them without variation (no called site with two alleles), and mean and mode of called sites per locus.

    `sites` (locus) lists all loci; the mode of several is the least. No loci: zeros and nulls.
    """
    by = calls.groupBy("locus", "site_id").agg((F.min(F.least("a1", "a2")) != F.max(F.greatest("a1", "a2"))).alias("varies"))
    by = by.groupBy("locus").agg(F.count(F.lit(1)).alias("snps"), F.bool_or("varies").alias("varies"))
    all_ = sites.select("locus").distinct().join(by, "locus", "left").select(F.coalesce("snps", F.lit(0)).alias("snps"), F.coalesce("varies", F.lit(False)).alias("varies"))
    per = all_.groupBy("snps").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("varies")).alias("invariant"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("loci"), F.coalesce(F.sum("invariant"), F.lit(0)).alias("invariant"), (F.sum(F.col("n") * F.col("snps")) / F.sum("n")).alias("mean"), F.max_by("snps", F.struct("n", -F.col("snps"))).alias("mode"))


def dataset_size(calls: DataFrame, *by: str) -> DataFrame:
    return calls.groupBy(*by).agg(F.countDistinct("locus").alias("loci"), F.countDistinct("site_id").alias("snps"), F.countDistinct("sample").alias("samples"))


def locus_length_stats(tags: DataFrame) -> DataFrame:
    """n, mean, least, greatest and population stdev of the lengths of sequences."""
    n = F.length("seq")
    return tags.agg(F.count(F.lit(1)).alias("n"), F.avg(n).alias("mean"), F.min(n).alias("least"), F.max(n).alias("greatest"), F.stddev_pop(n).alias("sd"))


def genotype_codes(calls: DataFrame) -> DataFrame:
    """Distinct sorted genotypes of the data."""
    return calls.select(F.array_join(F.array_sort(F.array("a1", "a2")), "").alias("code")).distinct()


def one_snp_per_locus(sites: DataFrame, score: Column, tie: Column | None = None) -> DataFrame:
    """The site of greatest score of each locus; ties go to the first in file order (site_id).

    A partial aggregate, not a window: no sort, and one row per locus and task is shuffled.
    """
    first = -F.col("site_id") if tie is None else tie
    best = sites.groupBy("locus").agg(F.max_by(F.struct(*sites.columns), F.struct(score, first)).alias("s"))
    return best.select("s.*")


def random_per_pop(samples: DataFrame, n: int, order: Column) -> DataFrame:
    """n samples of each population, by the order of a column (a hash of a seed and the name)."""
    return samples.withColumn("_r", F.row_number().over(W.partitionBy("pop").orderBy(order, "sample"))).where(F.col("_r") <= n).drop("_r")


def random_loci(df: DataFrame, share: float = 0.75, seed: int = 1) -> DataFrame:
    """Rows of about `share` of all loci, by a repeatable number from the MD5 of seed and locus; all rows of a locus or none."""
    number = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("locus").cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    return df.where(number < share)


def downsample(sites: DataFrame, n: int, order: Column | None = None, seed: int = 1) -> DataFrame:
    """Exactly n sites (all, if fewer), the least in the order of a column of longs, ties by site_id; by default a hash of seed and id. No sort."""
    return smallest(sites, n, F.xxhash64(F.lit(seed), "site_id") if order is None else order, F.col("site_id"))


def with_site_index(sites: DataFrame, *order: str) -> DataFrame:
    """Consecutive numbers in the order of columns: counts of range partitions, then places in each."""
    parts = sites.repartitionByRange(*order).withColumn("_p", F.spark_partition_id())
    parts = parts.withColumn("_i", F.row_number().over(W.partitionBy("_p").orderBy(*order)))
    size = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    ahead = size.withColumn("_before", F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1))).select("_p", F.coalesce("_before", F.lit(0)).alias("_before"))
    return parts.join(F.broadcast(ahead), "_p").withColumn("site_idx", F.col("_before") + F.col("_i") - 1).drop("_p", "_i", "_before")
