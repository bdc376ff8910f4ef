"""Whole tables of diversity, a row for each population."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .loci import alignment_by_sample, alignment_diversity
from .population import site_pop


def _se_with_zeros(total: Column, squares: Column, n: Column) -> Column:
    """Standard error of the mean of n values, of which those not summed are zero."""
    mean = total / F.nullif(n, F.lit(0.0))
    return F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), squares - n * mean * mean) / (n - 1) / n))


def autosomal_table(calls: DataFrame, samples: DataFrame, invariant: DataFrame, taxa: DataFrame | None = None, seed: int = 1) -> DataFrame:
    """Samples, loci and SNPs of complete sites, Ho and He over all sites, and Ho, uHe and Fis of unlinked SNPs, with standard errors.

    A site counts where every sample of the population (`samples`: sample, pop) is called. `invariant`
    (taxon, invariant) has the loci without variation of each taxon, of which a population's share is that
    of its loci; `taxa` (pop, taxon) gives a population's taxon, and sites that do not vary within a taxon
    are dropped for its populations; populations without a taxon have no row. Without `taxa` all are one
    taxon, the null one, and no site is dropped. An invariant locus has heterozygosity 0, in means and standard errors.
    Unlinked: of each locus the variable site of least MD5 of seed and site. uHe = He 2n / (2n - 1); Fis is the mean of
    1 - Ho / uHe. A population without a complete site has counts of 0 and nulls.
    """
    pops = samples.where("pop is not null").groupBy("pop").agg(F.count(F.lit(1)).alias("samples"))
    pops = pops.withColumn("taxon", F.lit(None).cast("string")) if taxa is None else pops.join(taxa.select("pop", "taxon"), "pop")
    sp = site_pop(calls).join(pops, "pop")
    if taxa is not None:
        varies = sp.groupBy("taxon", "site_id").agg(F.sum("alt").alias("a"), F.sum("n").alias("m")).where("a > 0 and a < 2 * m").select("taxon", "site_id")
        sp = sp.join(varies, ["taxon", "site_id"], "left_semi")
    n, p = F.col("n"), F.col("alt") / (2 * F.col("n"))
    he = 2 * p * (1 - p)
    order = F.when((p > 0) & (p < 1), F.md5(F.concat(F.lit(f"{seed}:"), F.col("site_id").cast("string"))))
    # One row for each locus of a population, then one for each population: sites are shuffled as partial sums.
    sums = [x for c in ("ho", "he") for x in (F.sum(c).alias(c), F.sum(F.col(c) * F.col(c)).alias(f"{c}2"))]
    full = sp.withColumns({"complete": n == F.col("samples"), "ho": F.col("x1") / n, "he": he, "uhe": he * 2 * n / (2 * n - 1), "order": order})
    zeroed = full.withColumns({c: F.when(F.col("complete"), F.col(c)) for c in ("ho", "he", "uhe", "order")})
    loci = zeroed.groupBy("taxon", "pop", "locus").agg(F.count_if("complete").alias("snps"), *sums, F.min_by(F.struct("ho", "uhe"), "order").alias("one"))
    loci = loci.withColumns({"ho1": F.col("one.ho"), "uhe1": F.col("one.uhe"), "fis1": 1 - F.col("one.ho") / F.nullif(F.col("one.uhe"), F.lit(0.0))})
    ones = [x for c, name in (("ho1", "ho_snp"), ("uhe1", "uhe_snp"), ("fis1", "fis")) for x in (F.avg(c).alias(name), F.sqrt(F.var_samp(c) / F.count(c)).alias(f"{name}_se"))]
    got = loci.groupBy("taxon", "pop").agg(
        F.count_if(F.col("snps") > 0).alias("loci_auto"), F.sum("snps").alias("snps"), *[F.sum(c).alias(c) for c in ("ho", "ho2", "he", "he2")], F.count("one").alias("unlinked_snps"), *ones
    )
    all_loci = sp.groupBy("taxon").agg(F.countDistinct("locus").alias("all_loci"))
    same = lambda a, b: a["taxon"].eqNullSafe(b["taxon"])
    known = all_loci.join(invariant, same(all_loci, invariant), "left").select(all_loci["taxon"].alias("_t"), "all_loci", "invariant")
    got = got.join(known, F.col("taxon").eqNullSafe(F.col("_t"))).drop("taxon", "_t")
    total = F.col("snps") + F.col("loci_auto") / F.col("all_loci") * F.coalesce("invariant", F.lit(0))
    auto = [x for c in ("ho", "he") for x in ((F.col(c) / F.nullif(total, F.lit(0.0))).alias(f"{c}_auto"), _se_with_zeros(F.col(c), F.col(f"{c}2"), total).alias(f"{c}_auto_se"))]
    table = got.select("pop", "loci_auto", "snps", *auto, "unlinked_snps", "ho_snp", "ho_snp_se", "uhe_snp", "uhe_snp_se", "fis", "fis_se")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("loci_auto", "snps", "unlinked_snps")}
    return pops.select("pop", "samples").join(table, "pop", "left").withColumns(zero)


def alignment_table(seqs: DataFrame, samples: DataFrame) -> DataFrame:
    """The 17 columns of alignments: means over a population's loci, with standard errors, then means over its samples.

    `seqs` (locus, sample, seq); samples without a population (`samples`: sample, pop) are left out.
    Sites and polymorphic sites are sums over loci. Missing % of a locus is of all samples of the population.
    """
    people = samples.where("pop is not null").select("sample", "pop")
    size = people.groupBy("pop").agg(F.count(F.lit(1)).alias("size"))
    own = seqs.select("locus", "sample", "seq").join(people, "sample")
    # A locus of each population is a locus of its own, under a name of the length of the population's, it and the locus.
    name = F.concat(F.length("pop").cast("string"), F.lit(":"), "pop", F.col("locus").cast("string"))
    loci = alignment_diversity(own.withColumn("locus", name), 1)
    loci = loci.withColumn("pop", F.expr("substr(locus, instr(locus, ':') + 1, int(substr(locus, 1, instr(locus, ':') - 1)))")).join(size, "pop")
    loci = loci.withColumn("missing_percent", 100 * (1 - (1 - F.col("missing_percent") / 100) / F.col("size")))
    se = lambda c: F.sqrt(F.var_samp(c) / F.count(c))
    means = [x for c in ("ho", "pi", "fis") for x in (F.avg(c).alias(c), se(c).alias(f"{c}_se"))]
    by_locus = loci.groupBy("pop").agg(F.avg("samples").alias("samples"), F.count(F.lit(1)).alias("loci"), F.sum("sites").alias("sites"), F.sum("polymorphic").alias("polymorphic"), F.avg("missing_percent").alias("missing_percent"), *means)
    each = alignment_by_sample(own).join(people, "sample")
    by_sample = each.groupBy("pop").agg(
        F.avg("loci").alias("samples_loci"), F.avg("sites").alias("samples_sites"), F.avg("polymorphic").alias("samples_polymorphic"),
        (100 * F.avg(F.col("missing") / F.nullif("sites", F.lit(0)))).alias("samples_missing"), F.avg("ho").alias("samples_ho"), se("ho").alias("samples_ho_se"),
    )
    return by_locus.join(by_sample, "pop")
