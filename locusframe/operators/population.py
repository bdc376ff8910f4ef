"""Diversity within and differentiation between populations.

All of it starts from one aggregate per site and population (`site_pop`), so the long table is read
once and samples are never paired.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.sides import small_side


def site_pop(calls: DataFrame) -> DataFrame:
    """n called, alt alleles, and counts of genotypes x0, x1, x2, per site and population."""
    is_ = lambda v: F.count_if(F.col("dosage") == v)
    return calls.where("pop is not null").groupBy("site_id", "locus", "pop").agg(
        F.count(F.lit(1)).alias("n"), F.sum("dosage").cast("long").alias("alt"), is_(0).alias("x0"), is_(1).alias("x1"), is_(2).alias("x2")
    )


def allele_freq(sp: DataFrame) -> DataFrame:
    """Frequency of the ALT allele."""
    return sp.select("site_id", "locus", "pop", (F.col("alt") / (2 * F.col("n"))).alias("freq"))


def allele_counts(sp: DataFrame, pops: list[str]) -> DataFrame:
    """"ref,alt" counts of each population as columns; 0,0 where nothing is called."""
    cell = F.concat_ws(",", (2 * F.col("n") - F.col("alt")).cast("string"), F.col("alt").cast("string"))
    got = sp.withColumn("cell", cell).groupBy("site_id").pivot("pop", pops).agg(F.first("cell"))
    return got.select("site_id", *[F.coalesce(F.col(f"`{p}`"), F.lit("0,0")).alias(p) for p in pops])


def nei(sp: DataFrame) -> DataFrame:
    """Ho, Hs and Fis of Nei (1987) per site and population; Hs null under 2 samples, Fis where Hs = 0."""
    n, p = F.col("n"), F.col("alt") / (2 * F.col("n"))
    ho = F.col("x1") / n
    hs = F.when(n > 1, n / (n - 1) * (1 - (p * p + (1 - p) * (1 - p)) - ho / (2 * n)))
    got = sp.withColumn("ho", ho).withColumn("hs", hs)
    return got.withColumn("fis", F.when(F.abs("hs") > 1e-12, 1 - F.col("ho") / F.col("hs")))


def _se(c: str) -> Column:
    """Standard error: sqrt(sample variance / number of values)."""
    return F.sqrt(F.var_samp(c) / F.count(c))


def basic_stats(sp: DataFrame, samples: DataFrame, n_sites: int) -> DataFrame:
    """Table of populations: samples, SNPs, missing %, and mean and SE of Ho, Hs and Fis."""
    size = samples.groupBy("pop").agg(F.count(F.lit(1)).alias("samples"))
    means = [x for c in ("ho", "hs", "fis") for x in (F.avg(c).alias(c), _se(c).alias(f"{c}_se"))]
    got = nei(sp).groupBy("pop").agg(F.count(F.lit(1)).alias("snps"), F.sum("n").alias("calls"), *means)
    return got.join(small_side(size), "pop").withColumn("missing_percent", 100 * (1 - F.col("calls") / (F.col("samples") * n_sites))).drop("calls")


def gene_diversity_normal(sp: DataFrame) -> DataFrame:
    """1 - sum of C(n_i, 2) / C(n, 2) over alleles, per site and population; null under 2 alleles."""
    a, r = F.col("alt"), 2 * F.col("n") - F.col("alt")
    t = a + r
    return sp.select("site_id", "locus", "pop", F.when(t > 1, 1 - (a * (a - 1) + r * (r - 1)) / (t * (t - 1))).alias("gd"))


def gene_diversity_inbred(sp: DataFrame) -> DataFrame:
    """(n / (n - 2)) (1 - sum (n_i / n)^2 - (1 / n) (1 - sum 2 N_i / n)), N_i homozygotes of allele i.

    n counts alleles; null where it is 2 or less.
    """
    n = (2 * F.col("n")).cast("double")
    a = F.col("alt") / n
    hom = 2 * (F.col("x0") + F.col("x2")) / n
    return sp.select("site_id", "locus", "pop", F.when(n > 2, n / (n - 2) * (1 - (a * a + (1 - a) * (1 - a)) - (1 - hom) / n)).alias("gd"))


def autosomal_heterozygosity(calls: DataFrame, samples: DataFrame, invariant_loci: int) -> DataFrame:
    """Per population over its complete sites: Ho and He, and both scaled by S / (S + I).

    I: invariant loci, in proportion to the population's share of all loci. uHe = He 2n / (2n - 1),
    Fis = 1 - Ho / uHe over the variable sites.
    """
    from .filters import complete_sites_in_pop

    full = complete_sites_in_pop(calls, samples)
    sp = site_pop(calls.join(full, ["pop", "site_id"], "left_semi"))
    p = F.col("alt") / (2 * F.col("n"))
    per = sp.withColumn("ho", F.col("x1") / F.col("n")).withColumn("he", 2 * p * (1 - p)).withColumn("uhe", 2 * p * (1 - p) * 2 * F.col("n") / (2 * F.col("n") - 1)).withColumn("varies", (p > 0) & (p < 1))
    all_loci = calls.agg(F.countDistinct("locus").alias("all_loci"))
    var = lambda c: F.avg(F.when(F.col("varies"), F.col(c)))
    got = per.groupBy("pop").agg(F.countDistinct("locus").alias("loci"), F.count(F.lit(1)).alias("snps"), F.count_if("varies").alias("variable"), F.avg("ho").alias("ho"), F.avg("he").alias("he"), var("ho").alias("ho_snp"), var("uhe").alias("uhe_snp"))
    scale = F.col("snps") / (F.col("snps") + F.col("loci") / F.col("all_loci") * invariant_loci)
    return got.crossJoin(F.broadcast(all_loci)).select(
        "pop", "loci", "snps", "variable", (F.col("ho") * scale).alias("ho_auto"), (F.col("he") * scale).alias("he_auto"), "ho_snp", "uhe_snp",
        (1 - F.col("ho_snp") / F.nullif("uhe_snp", F.lit(0.0))).alias("fis"),
    )


def pop_pairs(sp: DataFrame, least: int = 2) -> DataFrame:
    """The aggregates of two populations side by side, at sites where both have `least` samples."""
    ok = sp.where(F.col("n") >= least)
    cols = ("n", "alt", "x0", "x1", "x2")
    x = ok.select("site_id", F.col("pop").alias("pop_a"), *[F.col(c).alias(f"{c}_a") for c in cols])
    y = ok.select("site_id", F.col("pop").alias("pop_b"), *[F.col(c).alias(f"{c}_b") for c in cols])
    return x.join(y, "site_id").where("pop_a < pop_b")


def reich_fst(sp: DataFrame) -> DataFrame:
    """Fst of Reich et al. (2009): sum N / sum D over sites, 4 decimals, per pair of populations."""
    j = pop_pairs(sp)

    def part(s: str):
        a, n = F.col(f"alt_{s}").cast("double"), 2.0 * F.col(f"n_{s}")
        return a / n, a * (n - a) / (n * (n - 1)), n

    (p1, h1, n1), (p2, h2, n2) = part("a"), part("b")
    num = (p1 - p2) * (p1 - p2) - h1 / n1 - h2 / n2
    return j.groupBy("pop_a", "pop_b").agg(F.count(F.lit(1)).alias("sites"), F.round(F.sum(num) / F.sum(num + h1 + h2), 4).alias("fst"))


def reich_fst_inbred(sp: DataFrame, fraction: float = 1.0, seed: int = 1) -> DataFrame:
    """The form for inbred samples, from genotype counts; `fraction` of the sites by a repeatable hash."""
    j = pop_pairs(sp)
    if fraction < 1:
        j = j.where(F.pmod(F.xxhash64(F.lit(seed), "site_id", "pop_a", "pop_b"), F.lit(1_000_000)) < int(fraction * 1_000_000))
    x0, x1, x2, s = (F.col(c).cast("double") for c in ("x0_a", "x1_a", "x2_a", "n_a"))
    y0, y1, y2, t = (F.col(c).cast("double") for c in ("x0_b", "x1_b", "x2_b", "n_b"))
    h = lambda a0, a1, a2, m: (4 * a0 * a2 + 2 * a1 * (a0 + a2) + a1 * (a1 - 1)) / (4 * m * (m - 1))
    h1, h2 = h(x0, x1, x2, s), h(y0, y1, y2, t)
    d = t * x1 + 2 * t * x2 - s * y1 - 2 * s * y2
    big = (d * d + x1 * t * t + y1 * s * s) / (4 * s * s * t * t)
    num = big - h1 / s - h2 / t
    return j.groupBy("pop_a", "pop_b").agg(F.count(F.lit(1)).alias("sites"), F.round(F.sum(num) / F.sum(num + h1 + h2), 4).alias("fst"))


def wc_fst(sp: DataFrame) -> DataFrame:
    """Theta of Weir and Cockerham (1984): sum a / sum (a + b + c) per pair of populations."""
    j = pop_pairs(sp, 1)
    n1, n2 = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    p1, p2, h1, h2 = F.col("alt_a") / (2 * n1), F.col("alt_b") / (2 * n2), F.col("x1_a") / n1, F.col("x1_b") / n2
    nbar = (n1 + n2) / 2
    nc = 2 * nbar - (n1 * n1 + n2 * n2) / (2 * nbar)
    p = (n1 * p1 + n2 * p2) / (2 * nbar)
    s2 = (n1 * (p1 - p) * (p1 - p) + n2 * (p2 - p) * (p2 - p)) / nbar
    h = (n1 * h1 + n2 * h2) / (2 * nbar)
    v = p * (1 - p) - s2 / 2
    a = nbar / nc * (s2 - (v - h / 4) / (nbar - 1))
    b = nbar / (nbar - 1) * (v - (2 * nbar - 1) * h / (4 * nbar))
    return j.where(nbar > 1).groupBy("pop_a", "pop_b").agg(F.count(F.lit(1)).alias("sites"), (F.sum(a) / F.nullif(F.sum(a + b + h / 2), F.lit(0.0))).alias("fst"))
