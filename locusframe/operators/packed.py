"""The packed form, and predicates on a site's array of calls; none of them shuffles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import genotype as G
from ..sources.sides import small_side


def by_place(df: DataFrame, keys: list[str], place: str, value: str | Column) -> DataFrame:
    """One row per group of `keys`: m, a map from place to value; of repeated places the least value stays. Null places are left out."""
    value = F.col(value) if isinstance(value, str) else value
    got = df.where(F.col(place).isNotNull()).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(place).alias("place"), value.alias("value")))).alias("all"))
    first = F.filter("all", lambda x, i: (i == 0) | (F.get("all", i - 1)["place"] != x["place"]))
    return got.select(*keys, F.map_from_entries(first).alias("m"))


def to_packed(calls: DataFrame, n_samples: int) -> DataFrame:
    """Packed sites from long calls: site_id, locus, pos, calls in the order of sample_idx.

    Repeated calls of a sample at a site: the least one (alleles, then depth) stays.
    """
    got = by_place(calls, ["site_id", "locus", "pos"], "sample_idx", F.struct(F.array("a1", "a2").alias("gt"), "dp"))
    empty = F.struct(F.array(F.lit(None).cast("int"), F.lit(None).cast("int")).alias("gt"), F.lit(None).cast("int").alias("dp"))
    calls = F.transform(F.sequence(F.lit(0), F.lit(n_samples - 1)), lambda i: F.coalesce(F.try_element_at("m", i), empty))
    # The map is named twice: named in the lambda alone, it would be put there and made anew for each sample.
    return got.select("site_id", "locus", "pos", F.when(F.size("m") >= 0, calls).alias("calls"))


def to_long(sites: DataFrame, samples: DataFrame) -> DataFrame:
    """Long calls from packed sites; `samples` (sample_idx, sample, ...) is broadcast: one row per column of the matrix."""
    exploded = sites.select("site_id", "locus", "pos", F.posexplode("calls").alias("sample_idx", "c")).where(G.is_called(F.col("c.gt")))
    long = exploded.select("site_id", "locus", "pos", "sample_idx", F.get("c.gt", F.lit(0)).alias("a1"), F.get("c.gt", F.lit(1)).alias("a2"), G.dosage(F.col("c.gt")).alias("dosage"), F.col("c.dp").alias("dp"))
    return long.join(small_side(samples), "sample_idx")


def called() -> Column:
    """Calls that are not missing."""
    return F.filter("calls", lambda c: G.is_called(c["gt"]))


def n_called() -> Column:
    return F.size(called())


def _alleles() -> Column:
    return F.filter(F.flatten(F.transform("calls", lambda c: c["gt"])), lambda a: a.isNotNull())


def allele_count(allele: int) -> Column:
    return F.size(F.filter(_alleles(), lambda a: a == allele))


def _depths() -> Column:
    return F.filter(F.transform(called(), lambda c: c["dp"]), lambda d: d.isNotNull())


def _positive() -> Column:
    return F.filter(_depths(), lambda d: d > 0)


def mean_depth() -> Column:
    """Mean of the depths above zero; null if there is none."""
    d = _positive()
    return F.when(F.size(d) > 0, F.aggregate(d, F.lit(0).cast("long"), lambda s, x: s + x) / F.size(d))


def pop_called(pops: list[str | None]) -> Column:
    """Population of each called sample; `pops` in the order of the samples."""
    of = F.array(*[F.lit(p) for p in pops])
    return F.filter(F.transform("calls", lambda c, i: F.when(G.is_called(c["gt"]), F.get(of, i))), lambda p: p.isNotNull())


def biallelic(alleles: str = "alleles") -> Column:
    return F.size(alleles) == 2


def require_pops(pops: list[str | None], wanted: list[str]) -> Column:
    """Every wanted population has a called sample."""
    return F.size(F.array_except(F.array(*map(F.lit, wanted)), pop_called(pops))) == 0


def min_per_pop(pops: list[str | None], n: int) -> Column:
    """Every population of the table has n called samples at least."""
    have = pop_called(pops)
    enough = lambda p: F.size(F.filter(have, lambda x: x == p)) >= n
    return reduce(lambda a, b: a & b, [enough(p) for p in sorted({p for p in pops if p is not None})])


def min_pops(pops: list[str | None], n: int) -> Column:
    """Called samples come from n populations at least."""
    return F.size(F.array_distinct(pop_called(pops))) >= n


def min_call_rate(rate: float) -> Column:
    return n_called() / F.size("calls") >= rate


def min_mac(n: int) -> Column:
    """Alleles 0 and 1 both occur n times at least; other alleles do not count."""
    return (allele_count(0) >= n) & (allele_count(1) >= n)


def min_maf(t: float) -> Column:
    """Frequency of the rarer of alleles 0 and 1 is t at least; t over 1 is a count."""
    a, b = allele_count(0), allele_count(1)
    return F.least(a, b) >= t if t > 1 else F.when(a + b > 0, F.least(a, b) / (a + b) >= t).otherwise(False)


def max_depth(d: int) -> Column:
    """No depth above d; sites without depths pass."""
    return F.coalesce(F.array_max(_depths()) <= d, F.lit(True))


def min_depth(d: int) -> Column:
    """No depth below d; sites without depths fail."""
    return F.coalesce(F.array_min(_depths()) >= d, F.lit(False))


def max_mean_depth(d: float) -> Column:
    return F.coalesce(mean_depth() <= d, F.lit(False))


def min_mean_depth(d: float) -> Column:
    return F.coalesce(mean_depth() >= d, F.lit(False))


def mask_calls_by_depth(sites: DataFrame, lo: int, hi: int) -> DataFrame:
    """Calls whose depth lies outside [lo, hi] become missing; sites stay. No depth: missing."""
    return sites.withColumn("calls", F.transform("calls", lambda c: F.when(F.coalesce(c["dp"].between(lo, hi), F.lit(False)), c).otherwise(c.withField("gt", F.transform(c["gt"], lambda _: F.lit(None).cast("int"))))))


def polymorphic(rule: str = "genotypes") -> Column:
    """Whether a site stays when monomorphic ones are dropped.

    genotypes: two different genotypes are called. all_states: dosages are not all 0, all 1 or all
    2, nor all missing. alleles: two alleles are seen (a site of heterozygotes only stays).
    """
    if rule == "genotypes":
        return F.size(F.array_distinct(F.transform(called(), lambda c: F.array_sort(c["gt"])))) > 1
    if rule == "all_states":
        return F.size(F.array_distinct(F.filter(F.transform("calls", lambda c: G.dosage(c["gt"])), lambda d: d.isNotNull()))) > 1
    if rule == "alleles":
        return F.size(F.array_distinct(_alleles())) > 1
    raise ValueError(f"no such rule: {rule}")


def any_called() -> Column:
    """Not all samples are missing."""
    return n_called() > 0


def any_depth() -> Column:
    """Some call has a depth above zero."""
    return F.size(_positive()) > 0


def keep_columns(sites: DataFrame, idx: list[int]) -> DataFrame:
    """Packed sites with the samples of the given places only, in their order."""
    keep = F.array(*[F.lit(i).cast("int") for i in idx])
    if idx == sorted(set(idx)):  # the column stands outside of the lambda, so its expression runs once and not once for each place
        pick = lambda c: F.filter(c, lambda _, i: F.array_contains(keep, i))
    else:
        pick = lambda c: F.transform(keep, lambda i: F.get(c, i))
    return sites.withColumns({c: pick(c) for c in ("calls", "raw") if c in sites.columns})


def site_stats() -> list[Column]:
    """n_called, call_rate, n_ref, n_alt, maf, freq_hets, freq_hom_ref, freq_hom_snp, mean_depth."""
    d = F.filter(F.transform("calls", lambda c: G.dosage(c["gt"])), lambda x: x.isNotNull())
    n, share = F.size(d), lambda v: F.when(F.size(d) > 0, F.size(F.filter(d, lambda x: x == v)) / F.size(d))
    alt = F.aggregate(d, F.lit(0), lambda s, x: s + x)
    f = alt / (2 * n)
    return [
        n.cast("long").alias("n_called"), (n / F.size("calls")).alias("call_rate"), (2 * n - alt).cast("long").alias("n_ref"), alt.cast("long").alias("n_alt"),
        F.when(n > 0, F.least(f, 1 - f)).alias("maf"), share(1).alias("freq_hets"), share(0).alias("freq_hom_ref"), share(2).alias("freq_hom_snp"), F.round(mean_depth(), 1).alias("mean_depth"),
    ]
