"""Filters that look across samples, populations or loci (long calls unless said otherwise)."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from . import packed as P
from ..sources.sides import small_side
from .planes import Planes, from_calls
from .stats import with_site_index


def keep_samples(calls: DataFrame, ids: DataFrame) -> DataFrame:
    return calls.join(ids.select(F.col("id").alias("sample")).distinct(), "sample", "left_semi")


def drop_samples(calls: DataFrame, ids: DataFrame) -> DataFrame:
    return calls.join(ids.select(F.col("id").alias("sample")).distinct(), "sample", "left_anti")


def keep_pops_like(calls: DataFrame, pattern: str) -> DataFrame:
    return calls.where(F.col("pop").rlike(pattern))


def drop_pops(calls: DataFrame, pops: list[str]) -> DataFrame:
    """Samples without a population stay."""
    return calls.where(~F.coalesce(F.col("pop").isin(*pops), F.lit(False)))


def drop_outgroups(calls: DataFrame, marker: str = "Z") -> DataFrame:
    """Without samples whose name contains the mark of outgroups."""
    return calls.where(~F.col("sample").contains(marker))


def sample_missing_share(calls: DataFrame, samples: DataFrame, n_sites: int) -> DataFrame:
    """Share of sites at which each sample is missing; samples without calls: 1."""
    have = calls.groupBy("sample").agg(F.countDistinct("site_id").alias("n"))
    return samples.select("sample").join(have, "sample", "left").select("sample", (1 - F.coalesce("n", F.lit(0)) / F.lit(n_sites)).alias("missing"))


def _called_of(keep: list[int]):
    """Calls of the samples at given places that are not missing."""
    return F.filter(F.transform(F.array(*map(F.lit, keep)), lambda i: F.get("calls", i)), lambda c: P.G.is_called(c["gt"]))


def _present_enough(sites: DataFrame, keep: list[int], limit: float) -> list[int]:
    """Those of the places whose share of missing calls is under the limit; one count per sample reaches the driver."""
    if not keep:
        return []
    # One row per sample and task is shuffled: partial counts of the places that are called, and -1 for each site.
    called = F.filter(F.transform("calls", lambda c, i: F.when(P.G.is_called(c["gt"]), i)), lambda i: i.isNotNull())
    have = {r["i"]: r["count"] for r in sites.select(F.explode(F.array_append(called, F.lit(-1))).alias("i")).groupBy("i").count().collect()}
    n = have.get(-1, 0)
    return [i for i in keep if n and 1 - have.get(i, 0) / n < limit]


def drop_samples_by_missing(sites: DataFrame | Planes, samples: list[str], limit: float) -> tuple[DataFrame | Planes, list[str]]:
    """Sites without the samples whose share of missing calls is `limit` or more.

    Packed sites lose these columns. Planes are written once to the shared folder, counted, and lose these bits.
    """
    if isinstance(sites, Planes):
        sites = replace(sites, sites=written(sites.sites))
        have, n = sites.called_per_sample()
        keep = [i for i in range(len(samples)) if n and 1 - have[i] / n < limit]
        return sites.keep(keep), [samples[i] for i in keep]
    keep = _present_enough(sites, list(range(len(samples))), limit)
    return P.keep_columns(sites, keep), [samples[i] for i in keep]


def iterative_filter(
    sites: DataFrame, samples: list[str], site_steps: tuple = (0.2, 0.4, 0.6, 0.8), sample_steps: tuple = (0.9, 0.7, 0.5, 0.3), max_missing: float = 0.4, min_coverage: float = 0.9
) -> tuple[DataFrame, list[str]]:
    """Call-rate filter on sites and missingness filter on samples in turn, stricter each time.

    The packed sites are written once to the shared folder and read by each step, which adds a predicate
    over the places of the samples kept so far; the columns are cut once at the end.
    """
    sites, keep = written(sites), list(range(len(samples)))
    left = sites
    for rate, limit in zip(site_steps, sample_steps):
        left = left.where(F.size(_called_of(keep)) >= rate * len(keep))
        keep = _present_enough(left, keep, limit)
    keep = _present_enough(left, keep, max_missing)
    left = left.where(F.size(_called_of(keep)) >= min_coverage * len(keep))
    return P.keep_columns(left, keep), [samples[i] for i in keep]


def strict_filter(
    sites: DataFrame, samples: list[str], depth: bool = True, min_coverage: float = 0.9, max_missing: float = 0.4, dp: tuple[int, int] = (6, 500), mean_dp: float = 10, mac: int = 3
) -> tuple[DataFrame, list[str]]:
    """One pass over packed sites: with depth, mask calls by depth, then mean depth and allele counts; then rates.

    The sites are written once to the shared folder, so that their calls are not made anew for each predicate.
    """
    sites = written(sites)
    if depth:
        sites = P.mask_calls_by_depth(sites.where(P.min_mean_depth(mean_dp)), *dp).where(P.min_mac(mac))
    return drop_samples_by_missing(sites.where(P.min_call_rate(min_coverage)), samples, max_missing)


def strict_filter_calls(
    calls: DataFrame, samples: list[str], depth: bool = True, min_coverage: float = 0.9, max_missing: float = 0.4, dp: tuple[int, int] = (6, 500), mean_dp: float = 10, mac: int = 3, alleles: int = 2, unique: bool = False
) -> tuple[Planes, list[str]]:
    """`strict_filter` of long calls, whose `sample_idx` counts the samples: planes of the sites left. `alleles` and `unique`: see `from_calls`.

    Masks are laid where planes are made; mean depths are those of all calls.
    """
    p = from_calls(calls, len(samples), alleles, unique, depth=dp if depth else None, all_depths=True)
    if depth:
        p = p.where(p.min_mean_depth(mean_dp) & p.min_mac(mac))
    return drop_samples_by_missing(p.where(p.min_call_rate(min_coverage)), samples, max_missing)


def union_ids(*lists: DataFrame) -> DataFrame:
    """Ids (id) that are in any of the lists, each once; null ids are left out. No list at all is an error."""
    return reduce(DataFrame.unionByName, [x.select("id") for x in lists]).where("id is not null").distinct()


def drop_autapomorphic(calls: DataFrame) -> DataFrame:
    """Sites with over two genotypes, or with two that both occur in two populations or more."""
    key = F.array_sort(F.array("a1", "a2"))
    spread = calls.where(F.col("pop").isNotNull()).groupBy("site_id", key.alias("g")).agg(F.countDistinct("pop").alias("p"))
    keep = spread.groupBy("site_id").agg(F.count(F.lit(1)).alias("g"), F.min("p").alias("least")).where("g > 2 or (g = 2 and least >= 2)")
    return keep.select("site_id")


def drop_single_pop_polymorphisms(freqs: DataFrame, lo: float = 1e-4, hi: float = 0.99) -> DataFrame:
    """Sites that do not vary in exactly one population; `freqs`: site_id, pop, freq."""
    return freqs.groupBy("site_id").agg(F.count_if((F.col("freq") > lo) & (F.col("freq") < hi)).alias("n")).where("n != 1").select("site_id")


def filter_taglength(tags: DataFrame, lo: int = 65, hi: int = 69) -> DataFrame:
    return tags.where(F.length("seq").between(lo, hi))


def select_loci(seqs: DataFrame, loci: DataFrame, exclude: DataFrame | None = None, min_samples: int = 1) -> DataFrame:
    """Sequences of listed loci, without excluded samples, where enough samples are left."""
    kept = seqs.join(loci.select(F.col("id").alias("locus")).distinct(), "locus", "left_semi")
    if exclude is not None:
        kept = kept.join(exclude.select(F.col("id").alias("sample")).distinct(), "sample", "left_anti")
    enough = kept.groupBy("locus").agg(F.countDistinct("sample").alias("n")).where(F.col("n") >= min_samples).select("locus")
    return kept.join(enough, "locus", "left_semi")


def complete_sites_in_pop(calls: DataFrame, samples: DataFrame) -> DataFrame:
    """(pop, site_id) with every sample of the population called."""
    size = samples.groupBy("pop").agg(F.count(F.lit(1)).alias("size"))
    have = calls.join(small_side(samples.select("sample")), "sample", "left_semi").groupBy("pop", "site_id").agg(F.countDistinct("sample").alias("n"))
    return have.join(size, "pop").where("n = size").select("pop", "site_id")


#: Tags that share a segment up to which they are paired at once; beyond, they must share a second segment too.
HOT_TAGS = 64


def near_tags(tags: DataFrame, k: int, skip: int, length: int) -> DataFrame:
    """(a, b): numbers (`i`) of each two tags (i, seq) within k mismatches, a < b.

    k mismatches leave one of k + 1 segments equal, so tags meet by (segment, content). Where more than HOT_TAGS
    tags share one, k + 1 segments of the other bases leave one of those equal as well, and tags meet by
    both; so also by a third. Only tags that meet are compared.
    """

    def cuts(places: list[int]) -> list[list[int]]:
        return [places[len(places) * j // (k + 1) : len(places) * (j + 1) // (k + 1)] for j in range(k + 1)]

    def content(places: list[int]) -> Column:
        runs, out = [], []
        for p in places:  # places that follow each other are read at once
            if runs and runs[-1][-1] + 1 == p:
                runs[-1].append(p)
            else:
                runs.append([p])
        for r in runs:
            out.append(F.substring("seq", r[0] + 1, len(r)))
        return F.concat(F.lit(""), *out)

    def meeting(rows: DataFrame, places: list[int], level: int) -> DataFrame:
        """Pairs of `rows` (key, i, seq), which meet within their key."""
        sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        few = rows.join(sizes.where(F.col("n") <= HOT_TAGS) if level < 3 else sizes, "key", "left_semi")
        found = few.select("key", F.col("i").alias("a"), F.col("seq").alias("x")).join(few.select("key", F.col("i").alias("b"), F.col("seq").alias("y")), "key").where("a < b").select("a", "b", "x", "y")
        if level == 3 or len(places) < 2 * (k + 1):
            return found if level == 3 else found.unionByName(_all(rows.join(sizes.where(F.col("n") > HOT_TAGS), "key", "left_semi")))
        many = written(rows.join(sizes.where(F.col("n") > HOT_TAGS), "key", "left_semi"))
        if not many.limit(1).count():
            return found
        for own in cuts(places):
            again = many.withColumn("key", F.concat_ws("|", "key", F.lit(str(own[0])), content(own)))
            found = found.unionByName(meeting(again, [p for p in places if p not in own], level + 1))
        return found

    def _all(rows: DataFrame) -> DataFrame:
        return rows.select("key", F.col("i").alias("a"), F.col("seq").alias("x")).join(rows.select("key", F.col("i").alias("b"), F.col("seq").alias("y")), "key").where("a < b").select("a", "b", "x", "y")

    usable = list(range(skip, length))
    found = None
    for own in cuts(usable):
        first = tags.select(F.concat_ws("|", F.lit(str(own[0])), content(own)).alias("key"), "i", "seq")
        got = meeting(first, [p for p in usable if p not in own], 1)
        found = got if found is None else found.unionByName(got)
    pairs = found.dropDuplicates(["a", "b"])
    differ = F.size(F.filter(F.sequence(F.lit(skip + 1), F.lit(length)), lambda j: F.substring("x", j, F.lit(1)) != F.substring("y", j, F.lit(1))))
    return pairs.where(differ <= k).select("a", "b")


def filter_hamming(tags: DataFrame, threshold: float = 0.15, skip: int = 5, length: int = 69, rule: str = "order") -> DataFrame:
    """Tags left when of each pair within the threshold one is dropped.

    `tags`: locus, seq and, if known, rep_avg. The first `skip` bases do not count; k = floor(threshold * bases)
    mismatches are allowed. order: tags are taken in the order of reproducibility (greatest first, if there is
    rep_avg) and locus; a tag is dropped if one that is kept is near, so a tag near a dropped one only
    stays. It is a greedy independent set, made in rounds: of the undecided tags, those before all their
    neighbours are kept and their neighbours dropped; each round is written. input: a tag near any earlier locus goes, even if
    that one goes as well. Tags with equal bases are one; null and shorter sequences are compared as far as they go.
    """
    usable = length - skip
    k = int(threshold * usable)
    rank = [F.desc("rep_avg")] if rule == "order" and "rep_avg" in tags.columns else []
    body = F.coalesce(F.substring("seq", skip + 1, usable), F.lit(""))
    # Of tags with equal bases the first decides: it is near all the others, and has the same neighbours.
    order = F.struct(*([-F.coalesce("rep_avg", F.lit(float("-inf")))] if rank else []), F.col("locus"))
    classes = tags.withColumn("_body", body).groupBy("_body").agg(F.min(order).alias("o"), F.min_by("seq", order).alias("seq"), F.min_by("locus", order).alias("locus"))
    numbered = written(with_site_index(classes.select("o", "seq", "locus"), "o").select("locus", F.col("site_idx").alias("i"), "seq"))
    pairs = written(near_tags(numbered.select("i", "seq"), k, skip, length))
    if rule == "input":
        gone = pairs.select(F.col("b").alias("i")).distinct()
        return tags.join(numbered.join(gone, "i", "left_anti").select("locus"), "locus", "left_semi")
    kept, live = None, pairs
    while live.limit(1).count():
        # A tag that is no later one of an undecided pair is before all its undecided neighbours.
        first = live.select(F.col("a").alias("i")).distinct().join(live.select(F.col("b").alias("i")).distinct(), "i", "left_anti")
        lost = live.join(first, F.col("a") == F.col("i")).select(F.col("b").alias("i")).distinct()
        decided = written(first.withColumn("kept", F.lit(True)).unionByName(lost.withColumn("kept", F.lit(False))))
        kept = decided if kept is None else kept.unionByName(decided)
        gone = decided.select("i")
        live = written(live.join(gone, F.col("a") == F.col("i"), "left_anti").join(gone, F.col("b") == F.col("i"), "left_anti"))
    dropped = kept.where("not kept").select("i") if kept is not None else numbered.select("i").limit(0)
    return tags.join(numbered.join(dropped, "i", "left_anti").select("locus"), "locus", "left_semi")
