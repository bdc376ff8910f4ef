"""Replicate samples: error rates, reproducibility, thresholds and classes of pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.genotype import replicate_base
from ..sources.sides import small_side


def replicate_pairs(samples: DataFrame, marker: str = "_R") -> DataFrame:
    """Pairs by name: a sample with the marker belongs to the sample of its base name.

    An equal name is taken first; else the only sample whose name begins with the base.
    """
    reps = samples.where(F.col("sample").contains(marker)).select(F.col("sample").alias("sample_b"), replicate_base(F.col("sample"), marker).alias("base"))
    plain = samples.where(~F.col("sample").contains(marker)).select(F.col("sample").alias("sample_a"))
    exact = reps.join(plain, F.col("base") == F.col("sample_a"))
    rest = reps.join(exact.select("sample_b"), "sample_b", "left_anti").join(plain, F.col("sample_a").startswith(F.col("base")))
    unique = rest.groupBy("sample_b").agg(F.min("sample_a").alias("sample_a"), F.count(F.lit(1)).alias("n")).where("n = 1")
    return exact.select("sample_a", "sample_b").unionByName(unique.select("sample_a", "sample_b"))


def paired_calls(calls: DataFrame, reps: DataFrame, *by: str) -> DataFrame:
    """Both dosages of each replicate pair at each site that one of them has; null: missing."""
    long = reps.select("sample_a", "sample_b", F.explode(F.array(F.struct(F.col("sample_a").alias("sample"), F.lit(0).alias("side")), F.struct(F.col("sample_b").alias("sample"), F.lit(1).alias("side")))).alias("x")).select("sample_a", "sample_b", "x.*")
    hit = calls.join(small_side(long), "sample")
    side = lambda i: F.max(F.when(F.col("side") == i, F.col("dosage")))
    return hit.groupBy(*by, "sample_a", "sample_b", "locus", "site_id").agg(side(0).alias("da"), side(1).alias("db"))


def replicate_errors(calls: DataFrame, reps: DataFrame, *by: str) -> DataFrame:
    """Per pair (and further columns): locus, allele and SNP error in percent.

    Locus error: loci seen in one sample only, of those seen in either. Allele error: of the loci
    seen in both, those with a SNP that differs (missing in one only counts). SNP error: of the
    SNPs called in both, those that differ.
    """
    site = paired_calls(calls, reps, *by)
    both = F.col("da").isNotNull() & F.col("db").isNotNull()
    locus = site.groupBy(*by, "sample_a", "sample_b", "locus").agg(
        F.bool_or(F.col("da").isNotNull()).alias("in_a"), F.bool_or(F.col("db").isNotNull()).alias("in_b"),
        F.bool_or(~F.col("da").eqNullSafe(F.col("db"))).alias("differs"), F.count_if(both).alias("n_both"), F.count_if(both & (F.col("da") != F.col("db"))).alias("n_diff"),
    )
    shared = F.col("in_a") & F.col("in_b")
    pct = lambda a, b: 100 * a / F.nullif(b, F.lit(0))
    return locus.groupBy(*by, "sample_a", "sample_b").agg(
        pct(F.count_if(~shared), F.count(F.lit(1))).alias("locus_error"), pct(F.count_if(shared & F.col("differs")), F.count_if(shared)).alias("allele_error"),
        pct(F.sum("n_diff"), F.sum("n_both")).alias("snp_error"),
    )


def loci_overlap(calls: DataFrame, reps: DataFrame) -> DataFrame:
    """Per pair: loci seen in the first sample only, in the second only, and in both."""
    seen = paired_calls(calls, reps).groupBy("sample_a", "sample_b", "locus").agg(F.bool_or(F.col("da").isNotNull()).alias("a"), F.bool_or(F.col("db").isNotNull()).alias("b"))
    return seen.groupBy("sample_a", "sample_b").agg(F.count_if(F.col("a") & ~F.col("b")).alias("only_a"), F.count_if(F.col("b") & ~F.col("a")).alias("only_b"), F.count_if(F.col("a") & F.col("b")).alias("both"))


def reproducibility(calls: DataFrame, reps: DataFrame, n_pairs: int) -> DataFrame:
    """Per SNP: 1 - (pairs that differ) / pairs; missing in one differs, missing in both agrees."""
    wrong = paired_calls(calls, reps).groupBy("site_id").agg(F.count_if(~F.col("da").eqNullSafe(F.col("db"))).alias("d"))
    return calls.select("site_id").distinct().join(wrong, "site_id", "left").select("site_id", (1 - F.coalesce("d", F.lit(0)) / F.lit(n_pairs)).alias("rep_avg"))


def ordered(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Pairs with the smaller name first."""
    return pairs.withColumn("_lo", F.least(a, b)).withColumn("_hi", F.greatest(a, b)).drop(a, b).withColumnsRenamed({"_lo": a, "_hi": b})


def rep_pairs(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Comparisons of replicate pairs, in whichever order either table has them."""
    own = ordered(reps.select(F.col("sample_a").alias("a"), F.col("sample_b").alias("b")))
    return ordered(pairs).join(small_side(own), ["a", "b"], "left_semi")


def rep_distance_thresholds(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """One row of thresholds from the distances of replicates: mean, min, max, twice the mean,
    mean + 2 population sd, and Q3 + 1.5 times the interquartile range."""
    d = F.col("dist")
    q1, q3 = F.percentile(d, F.lit(0.25)), F.percentile(d, F.lit(0.75))
    return rep_pairs(pairs, reps).agg(F.avg(d).alias("mean"), F.min(d).alias("least"), F.max(d).alias("greatest"), (2 * F.avg(d)).alias("double_mean"), (F.avg(d) + 2 * F.stddev_pop(d)).alias("two_sd"), (q3 + 1.5 * (q3 - q1)).alias("outlier"))


def threshold(kind: str, row: DataFrame) -> Column:
    """The threshold of a kind: d (twice the mean), s, q, min or max, as a column of that row."""
    return F.col({"d": "double_mean", "s": "two_sd", "q": "outlier", "min": "least", "max": "greatest"}[kind])


def classify_pairs(pairs: DataFrame, reps: DataFrame, t: float) -> DataFrame:
    """Class of each comparison: rep_above, rep_below, rep_ok, possible_clone, high.

    A pair of a table of replicates is rep_above over t, rep_ok else. Two samples that both are
    replicates (of others) under t are rep_below; other pairs under t are possible clones.
    """
    own = ordered(reps.select(F.col("sample_a").alias("a"), F.col("sample_b").alias("b"))).withColumn("is_rep", F.lit(True))
    names = reps.select(F.col("sample_a").alias("s")).union(reps.select("sample_b")).distinct()
    p = ordered(pairs).join(small_side(own), ["a", "b"], "left")
    for side in "ab":
        p = p.join(small_side(names.select(F.col("s").alias(side), F.lit(True).alias(f"in_{side}"))), side, "left")
    both = F.coalesce("in_a", F.lit(False)) & F.coalesce("in_b", F.lit(False))
    kind = F.when(F.col("is_rep"), F.when(F.col("dist") > t, "rep_above").otherwise("rep_ok")).when(both & (F.col("dist") < t), "rep_below").when(F.col("dist") < t, "possible_clone").otherwise("high")
    return p.select("a", "b", "dist", kind.alias("class"))


def clone_report(pairs: DataFrame, reps: DataFrame, t: float) -> DataFrame:
    """Per class: number, least and greatest distance."""
    return classify_pairs(pairs, reps, t).groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.min("dist").alias("least"), F.max("dist").alias("greatest"))


def lowest(pairs: DataFrame, reps: DataFrame, t: float, n: int = 5) -> DataFrame:
    """The n lowest comparisons of class high."""
    return classify_pairs(pairs, reps, t).where("class = 'high'").orderBy("dist", "a", "b").limit(n)
