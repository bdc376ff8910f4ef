"""Comparisons of all pairs of samples, by products of indicator matrices over planes of bits (`tiles`)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import genotype as G
from ..sources.shared import written as _written
from . import tiles
from ..sources.sides import small_side
from .tiles import Dosages, Table, set_table

#: GENPOFAD of two sets of alleles, and MATCHSTATES: each allele of one is matched with its like in the other.
GENPOFAD = set_table(lambda a, b, both: 1 - both / max(a, b))
MATCHSTATES = set_table(lambda a, b, both: 1 - (both / a + both / b) / 2)


def places(calls: DataFrame, names: list[str] | None) -> tuple[DataFrame, list[str]]:
    """Calls with sample_idx as places 0, 1, ... of a list of names: of `names`, if given (in the order of sample_idx), else of the table's samples.

    Only names reach the driver. Null samples are left out.
    """
    if names is not None:
        return calls, names
    known = calls.where("sample is not null")
    people = [r["sample"] for r in known.groupBy("sample").agg(F.min("sample_idx").alias("i")).orderBy("i", "sample").collect()]
    at = calls.sparkSession.createDataFrame([(s, i) for i, s in enumerate(people)], "sample string, _place int")
    return known.join(small_side(at), "sample").withColumn("sample_idx", F.col("_place")).drop("_place"), people


def _named(sums: DataFrame, names: list[str]) -> DataFrame:
    lookup = F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")
    return sums.withColumn("a", F.get(lookup, F.col("i"))).withColumn("b", F.get(lookup, F.col("j"))).drop("i", "j")


def genotype_mismatch(calls: DataFrame, *by: str, names: list[str] | None = None) -> DataFrame:
    """Share of sites called in both samples whose genotypes differ, within groups of `by`. No shared site: no row."""
    return call_sums(calls, *by, names=names).select(*by, "a", "b", distance("mismatch").alias("dist"))


def pair_sums(sites: DataFrame, n: int, tile: int | None = None) -> DataFrame:
    """Sums over sites for each pair of samples, from packed sites: i, j (i < j), n_sites, shared, equal, absdiff, sqdiff, one_sided."""
    kernel = Dosages()
    words = lambda test: F.transform(F.sequence(F.lit(0), F.lit((n - 1) // 64)), lambda w: F.aggregate(F.slice(F.transform("calls", lambda c, i: F.when(F.coalesce(test(G.dosage(c["gt"])), F.lit(False)), tiles._bit(i % 64)).otherwise(F.lit(0).cast("long"))), w * 64 + 1, F.lit(64)), F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x)))
    rows = sites.select(words(lambda d: d.isNotNull()).alias("c"), *[words(lambda d, v=v: d < v).alias(f"b{v}") for v in range(1, kernel.top + 1)])
    return tiles.pair_sums(rows, [], kernel, n, tile)


def call_sums(calls: DataFrame, *by: str, names: list[str] | None = None, tile: int | None = None, top: int = 2) -> DataFrame:
    """The sums of `pair_sums` from long calls, within groups of `by`: a, b, n_sites and the sums, for pairs with a shared site.

    a comes before b in the order of sample_idx. Calls of a site are gathered once, as bits; no pairs of calls are
    made. Of repeated calls of a sample at a site the least dosage counts. Null dosages and samples
    are missing calls; a dosage above `top` counts as `top`. `names`: samples in the order of sample_idx, if
    known. No calls: no rows.
    """
    kernel = Dosages(top)
    at, people = places(calls, names)
    rows = tiles.bit_rows(at.where("dosage is not null"), [*by, "site_id"], kernel.planes, len(people))
    return _named(tiles.pair_sums(rows, list(by), kernel, len(people), tile).where("shared > 0"), people).select(*by, "a", "b", "n_sites", *kernel.names)


def distance(kind: str) -> Column:
    """A distance from the sums: mismatch, divergence (= 1 - IBS), ibs, missing or euclidean."""
    n = F.nullif("shared", F.lit(0.0))
    return {
        "mismatch": 1 - F.col("equal") / n,
        "divergence": F.col("absdiff") / (2 * n),
        "ibs": 1 - F.col("absdiff") / (2 * n),
        "missing": F.col("one_sided") / F.nullif(F.col("one_sided") + F.col("shared"), F.lit(0.0)),
        "euclidean": F.sqrt(F.col("sqdiff") * F.col("n_sites") / n),
    }[kind]


def block_distances(sites: DataFrame, samples: list[str], *kinds: str) -> DataFrame:
    """Pair table (a, b and one column for each kind) by matrix blocks. No shared site: no row."""
    names = F.array(*map(F.lit, samples))
    return pair_sums(sites, len(samples)).where("shared > 0").select(F.get(names, F.col("i")).alias("a"), F.get(names, F.col("j")).alias("b"), *[distance(k).alias(k) for k in kinds])


def call_distances(calls: DataFrame, names: list[str] | None, *kinds: str) -> DataFrame:
    """`block_distances` from long calls."""
    return call_sums(calls, names=names).select("a", "b", *[distance(k).alias(k) for k in kinds])


def dosage_divergence(calls: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Per pair: divergence, IBS and shared sites."""
    return call_sums(calls, names=names).select("a", "b", F.col("shared").cast("long").alias("shared"), distance("divergence").alias("divergence"), distance("ibs").alias("ibs"))


def divergence_summary(pairs: DataFrame) -> DataFrame:
    """One row: mean divergence, and the height of a tree, half the greatest one, 4 decimals."""
    return pairs.agg(F.avg("divergence").alias("mean"), F.round(F.max("divergence") / 2, 4).alias("height"))


def euclidean(calls: DataFrame, n_sites: int | None = None, names: list[str] | None = None) -> DataFrame:
    """Euclidean distance scaled up for missing sites: sqrt(sum of squares * all sites / shared); by default all sites with a call."""
    total = F.col("n_sites") if n_sites is None else F.lit(n_sites)
    return call_sums(calls, names=names).select("a", "b", F.sqrt(F.col("sqdiff") * total / F.col("shared")).alias("dist"))


def missing_mismatch(calls: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Sites called in exactly one of two samples, of those called in either."""
    return call_sums(calls, names=names).select("a", "b", distance("missing").alias("dist"))


def allele_set_distance(calls: DataFrame, *by: str, kind: Table = GENPOFAD, names: list[str] | None = None, tile: int | None = None) -> DataFrame:
    """Distance between sets of alleles per pair, mean over the sites called in both, within groups of `by` (Joly et al. 2015).

    GENPOFAD: 1 - |A and B| / max(|A|, |B|). MATCHSTATES: the share of the alleles of either that have no like in
    the other, mean of both directions; A against AG gives (0 + 1/2) / 2 = 0.25. Up to four alleles, numbered
    0 to 3; another number is an error. A call that lacks an allele is missing. No self-join.
    """
    at, people = places(calls, names)
    rows = tiles.bit_rows(at, [*by, "site_id"], kind.planes, len(people))
    got = _named(tiles.pair_sums(rows, list(by), kind, len(people), tile).where("shared > 0"), people)
    return got.select(*by, "a", "b", (F.col("total") / F.col("shared")).alias("dist"))


def _mean_total(sums: dict[str, np.ndarray], n_sites: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(sums["shared"] > 0, sums["total"] / sums["shared"], np.nan)


def _scaled_root(sums: dict[str, np.ndarray], n_sites: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(sums["shared"] > 0, np.sqrt(sums["sqdiff"] * n_sites / sums["shared"]), np.nan)


def locus_averaged(calls: DataFrame, method: str = "genpofad", names: list[str] | None = None, hot_sites: int = 100_000) -> DataFrame:
    """(a, b, dist, loci): a distance within each locus, then the plain mean over the loci that have data for the pair.

    genpofad and matchstates: see `allele_set_distance`. euclidean: of dosages, scaled up for a locus' sites
    (those with a call) that a pair does not share. Half calls have no dosage.
    """
    at, people = places(calls, names)
    kernel: Dosages | Table = {"genpofad": GENPOFAD, "matchstates": MATCHSTATES, "euclidean": Dosages()}[method]
    rows = tiles.bit_rows(at.where("dosage is not null") if method == "euclidean" else at, ["locus", "site_id"], kernel.planes, len(people))
    got = _named(tiles.locus_means(rows, kernel, len(people), _scaled_root if method == "euclidean" else _mean_total, hot_sites), people)
    return got.select("a", "b", (F.col("total") / F.col("loci")).alias("dist"), "loci")


def mean_by_pop_pairs(pairs: DataFrame, samples: DataFrame, min_samples: int = 3) -> DataFrame:
    """Distances within and between populations: n, least, mean, greatest.

    Within: populations of `min_samples` samples or more.
    """
    pop = samples.select("sample", "pop")
    big = samples.groupBy("pop").agg(F.count(F.lit(1)).alias("size"))
    j = pairs.join(small_side(pop.withColumnsRenamed({"sample": "a", "pop": "pa"})), "a").join(small_side(pop.withColumnsRenamed({"sample": "b", "pop": "pb"})), "b")
    j = j.withColumn("pop_a", F.least("pa", "pb")).withColumn("pop_b", F.greatest("pa", "pb")).join(small_side(big), F.col("pop_a") == F.col("pop"))
    j = j.where((F.col("pop_a") != F.col("pop_b")) | (F.col("size") >= min_samples))
    return j.groupBy("pop_a", "pop_b").agg(F.count(F.lit(1)).alias("n"), F.min("dist").alias("least"), F.avg("dist").alias("mean"), F.max("dist").alias("greatest"))


def symmetrise(pairs: DataFrame) -> DataFrame:
    """Both directions of each pair."""
    return pairs.select("a", "b", "dist").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "dist"))


def triangle(pairs: DataFrame, order: list[str]) -> DataFrame:
    """One triangle of a matrix in a given order of names; other names are left out."""
    place = F.array(*map(F.lit, order))
    both = symmetrise(pairs).distinct().withColumn("ia", F.array_position(place, F.col("a"))).withColumn("ib", F.array_position(place, F.col("b")))
    return both.where("ia > 0 and ib > 0 and ia < ib").select("a", "b", "dist")


def clone_groups(pairs: DataFrame, t: float = 0.02) -> DataFrame:
    """(sample, clone_group): components of the graph of pairs under t, named by the least sample.

    Labels travel along edges and then jump to their label's label; each round is written to the
    folder in spark.checkpoint.dir, where set. No pairs under t: no rows.
    """
    edges = pairs.where(F.col("dist") < t).select("a", "b")
    edges = _written(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label"))
    labels = _written(labels)
    while True:
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        jump = labels.select(F.col("node").alias("_n"), F.col("label").alias("far"))
        new = _written(step.join(jump, F.col("label") == F.col("_n")).select("node", "old", F.least("label", "far").alias("label")))
        labels = new.select("node", "label")
        if not new.where("old != label").limit(1).count():
            return labels.select(F.col("node").alias("sample"), F.col("label").alias("clone_group"))
