"""Genotype planes: the calls of a site as bits in a few long words, and predicates that count bits.

A site has one plane for each allele, with a bit for each sample that holds the allele, and a plane of
half calls. For two alleles that is two bits a call: neither bit is a missing call, one of them a
homozygote, both a heterozygote. Planes are made by one aggregate of OR-ed bits, which tasks start on their
own rows; what predicates read is then a handful of longs and four numbers about depths.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import genotype as G

#: Words of a plane up to which expressions are written out word by word, inside generated code; beyond, functions over arrays count.
UNROLLED = 8
_DEPTHS = ("dp_min", "dp_max", "dp_sum", "dp_n")


def n_words(n: int) -> int:
    return max(1, -(-n // 64))


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))


def mask_of(places: Iterable[int], n: int) -> list[int]:
    """Words with the bits of the given samples set, as signed 64-bit numbers."""
    words = [0] * n_words(n)
    for i in places:
        words[i // 64] |= 1 << (i % 64)
    return [w - (1 << 64) if w >> 63 else w for w in words]


def _depth_columns(dp: Column) -> list[Column]:
    at = F.when(dp > 0, dp)
    return [F.min(dp).alias("dp_min"), F.max(dp).alias("dp_max"), F.sum(at.cast("long")).alias("dp_sum"), F.count(at).alias("dp_n")]


@dataclass(frozen=True)
class Planes:
    """`sites` has site_id, locus, pos, further columns, p0, p1, ... and half (arrays of words), and dp_min, dp_max, dp_sum, dp_n.

    `n`: samples; `alleles`: number of planes. Depths are those of called samples, the sum and number of
    those above zero. Predicates are columns over `sites`.
    """

    sites: DataFrame
    n: int
    alleles: int = 2

    def where(self, condition: Column) -> Planes:
        return replace(self, sites=self.sites.where(condition))

    def with_column(self, name: str, column: Column) -> Planes:
        return replace(self, sites=self.sites.withColumn(name, column))

    # --- bits ---

    def _count(self, word: Callable[[Column], Column]) -> Column:
        """Bits of all words that `word` makes of a place."""
        n = n_words(self.n)
        if n <= UNROLLED:
            return reduce(lambda a, b: a + b, [F.bit_count(word(F.lit(i))) for i in range(n)])
        return F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), F.lit(0), lambda s, i: s + F.bit_count(word(i)))

    @staticmethod
    def _or(parts: list[Column]) -> Column:
        return reduce(lambda a, b: a.bitwiseOR(b), parts)

    def _plane(self, a: int, i: Column) -> Column:
        return F.get(f"p{a}", i)

    def _any(self, i: Column, without: int | None = None) -> Column:
        parts = [self._plane(a, i) for a in range(self.alleles) if a != without]
        return self._or(parts) if parts else F.lit(0).cast("long")

    def _half(self, i: Column) -> Column:
        return F.get("half", i)

    def _twice(self, a: int, i: Column) -> Column:
        """Samples with two copies of an allele."""
        return self._plane(a, i).bitwiseAND(F.bitwise_not(self._any(i, a).bitwiseOR(self._half(i))))

    def _pair(self, a: int, b: int, i: Column) -> Column:
        return self._twice(a, i) if a == b else self._plane(a, i).bitwiseAND(self._plane(b, i))

    def _full(self, i: Column) -> Column:
        """Samples without a missing allele."""
        return self._any(i).bitwiseAND(F.bitwise_not(self._half(i)))

    # --- counts ---

    def n_called(self) -> Column:
        """Samples with a known allele."""
        return self._count(self._any)

    def allele_count(self, allele: int) -> Column:
        if allele >= self.alleles:
            return F.lit(0)
        return self._count(lambda i: self._plane(allele, i)) + self._count(lambda i: self._twice(allele, i))

    def called_in(self, places: Iterable[int]) -> Column:
        """Called samples among those of the given places."""
        mask = F.array(*[F.lit(w).cast("long") for w in mask_of(places, self.n)])
        return self._count(lambda i: self._any(i).bitwiseAND(F.get(mask, i)))

    def mean_depth(self) -> Column:
        """Mean of the depths above zero; null if there is none."""
        return F.col("dp_sum") / F.nullif("dp_n", F.lit(0))

    # --- predicates ---

    def any_called(self) -> Column:
        return self.n_called() > 0

    def any_depth(self) -> Column:
        return F.col("dp_n") > 0

    def min_call_rate(self, rate: float) -> Column:
        return self.n_called() / F.lit(self.n) >= rate

    def min_mac(self, n: int) -> Column:
        """Alleles 0 and 1 both occur n times at least; other alleles do not count."""
        return (self.allele_count(0) >= n) & (self.allele_count(1) >= n)

    def min_maf(self, t: float) -> Column:
        """Frequency of the rarer of alleles 0 and 1 is t at least; t over 1 is a count."""
        a, b = self.allele_count(0), self.allele_count(1)
        return F.least(a, b) >= t if t > 1 else F.when(a + b > 0, F.least(a, b) / (a + b) >= t).otherwise(False)

    def require_pops(self, pops: list[str | None], wanted: list[str]) -> Column:
        """Every wanted population has a called sample; `pops` in the order of the samples."""
        return reduce(lambda a, b: a & b, [self.called_in(_places(pops, p)) > 0 for p in wanted], F.lit(True))

    def min_per_pop(self, pops: list[str | None], n: int) -> Column:
        """Every population of the table has n called samples at least."""
        return reduce(lambda a, b: a & b, [self.called_in(_places(pops, p)) >= n for p in sorted({p for p in pops if p is not None})], F.lit(True))

    def min_pops(self, pops: list[str | None], n: int) -> Column:
        """Called samples come from n populations at least."""
        return reduce(lambda a, b: a + b, [(self.called_in(_places(pops, p)) > 0).cast("int") for p in sorted({p for p in pops if p is not None})], F.lit(0)) >= n

    def max_depth(self, d: int) -> Column:
        """No depth above d; sites without depths pass."""
        return F.coalesce(F.col("dp_max") <= d, F.lit(True))

    def min_depth(self, d: int) -> Column:
        """No depth below d; sites without depths fail."""
        return F.coalesce(F.col("dp_min") >= d, F.lit(False))

    def max_mean_depth(self, d: float) -> Column:
        return F.coalesce(self.mean_depth() <= d, F.lit(False))

    def min_mean_depth(self, d: float) -> Column:
        return F.coalesce(self.mean_depth() >= d, F.lit(False))

    def polymorphic(self, rule: str = "genotypes") -> Column:
        """Whether a site stays when monomorphic ones are dropped.

        genotypes: two different genotypes are called. all_states: dosages are not all 0, all 1 or all
        2, nor all missing. alleles: two alleles are seen (a site of heterozygotes only stays).
        """
        seen = lambda word: (self._count(word) > 0).cast("int")
        pairs = [(a, b) for a in range(self.alleles) for b in range(a, self.alleles)]
        if rule == "genotypes":
            kinds = [seen(lambda i, a=a, b=b: self._pair(a, b, i)) for a, b in pairs]
            kinds += [seen(lambda i, a=a: self._plane(a, i).bitwiseAND(self._half(i))) for a in range(self.alleles)]
        elif rule == "all_states":
            sums = {s: [p for p in pairs if sum(p) == s] for s in sorted({sum(p) for p in pairs})}
            kinds = [seen(lambda i, own=own: self._or([self._pair(a, b, i) for a, b in own])) for own in sums.values()]
        elif rule == "alleles":
            kinds = [seen(lambda i, a=a: self._plane(a, i)) for a in range(self.alleles)]
        else:
            raise ValueError(f"no such rule: {rule}")
        return reduce(lambda a, b: a + b, kinds) > 1

    def site_stats(self) -> list[Column]:
        """n_called, call_rate, n_ref, n_alt, maf, freq_hets, freq_hom_ref, freq_hom_snp, mean_depth, of calls without a missing allele."""
        n = self._count(self._full)
        alt = reduce(lambda a, b: a + b, [a * (self._count(lambda i, a=a: self._plane(a, i).bitwiseAND(self._full(i))) + self._count(lambda i, a=a: self._twice(a, i))) for a in range(1, self.alleles)], F.lit(0))
        state = lambda s: self._count(lambda i: self._or([F.lit(0).cast("long"), *[self._pair(a, s - a, i) for a in range(s // 2 + 1) if s - a < self.alleles]]))
        share = lambda s: F.when(n > 0, state(s) / n)
        f = alt / (2 * n)
        return [
            n.cast("long").alias("n_called"), (n / F.lit(self.n)).alias("call_rate"), (2 * n - alt).cast("long").alias("n_ref"), alt.cast("long").alias("n_alt"),
            F.when(n > 0, F.least(f, 1 - f)).alias("maf"), share(1).alias("freq_hets"), share(0).alias("freq_hom_ref"), share(2).alias("freq_hom_snp"), F.round(self.mean_depth(), 1).alias("mean_depth"),
        ]

    # --- samples ---

    def keep(self, places: list[int]) -> Planes:
        """Calls of the samples of the given places only. Places stay; depths stay those of all samples."""
        mask = F.array(*[F.lit(w).cast("long") for w in mask_of(places, self.n)])
        cut = lambda c: F.zip_with(c, mask, lambda x, m: x.bitwiseAND(m))
        return replace(self, sites=self.sites.withColumns({c: cut(c) for c in self.columns}))

    @property
    def columns(self) -> list[str]:
        return [*(f"p{a}" for a in range(self.alleles)), "half"]

    def called_per_sample(self) -> tuple[list[int], int]:
        """Called sites of each sample, and all sites. Tasks add up bits; one row of counts for each of some salts reaches the driver."""
        n, names = self.n, [f"p{a}" for a in range(self.alleles)]

        def run(batches):
            acc, rows = np.zeros(n, np.int64), 0
            for pdf in batches:
                acc += (dosages(pdf, n, names, half=False) >= 0).sum(0)
                rows += len(pdf)
            yield pd.DataFrame({"rows": [rows], "n": [acc]})

        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"rows": [pdf["rows"].sum()], "n": [np.sum(np.stack(pdf.n.to_numpy()), axis=0)]})

        schema = "rows long, n array<long>"
        parts = self.sites.select(*self.columns).mapInPandas(run, schema).withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(32)))
        got = parts.groupBy("salt").applyInPandas(lambda pdf: add(pdf.drop(columns="salt")), schema).collect()
        return np.sum([r["n"] for r in got], axis=0).tolist() if got else [0] * n, sum(r["rows"] for r in got)


def _places(pops: list[str | None], pop: str) -> list[int]:
    return [i for i, p in enumerate(pops) if p == pop]


def dosages(pdf: pd.DataFrame, n: int, planes: list[str], half: bool = True) -> np.ndarray:
    """Sums of allele numbers, sites x samples, -1 for missing; with `half`, also for calls that miss an allele, which else count as if complete."""
    bits = lambda c: np.unpackbits(np.stack(pdf[c].to_numpy()).astype("<i8").view(np.uint8), axis=1, bitorder="little")[:, :n].astype(bool) if len(pdf) else np.zeros((0, n), bool)
    held = [bits(c) for c in planes]
    copies = np.sum(held, axis=0, dtype=np.int16)
    g = np.full((len(pdf), n), -1, np.int16)
    known = copies > 0
    once = copies == 1
    total = np.sum([a * h * np.where(once, 2, 1) for a, h in enumerate(held)], axis=0, dtype=np.int16)
    g[known] = total[known]
    if half:
        g[bits("half")] = -1
    return g.astype(np.int8)


def from_calls(calls: DataFrame, n: int, alleles: int = 2, unique: bool = False, depth: tuple[int, int] | None = None, all_depths: bool = False) -> Planes:
    """Planes of long calls (site_id, locus, pos, sample_idx, a1, a2, dp) of n samples, by one aggregate.

    `unique`: no sample is called twice at a site. Else, of repeated calls, the least (alleles, then depth)
    stays, as in `packed.to_packed`; rows are brought together by site once for that. `depth`: calls
    whose depth lies outside, or is missing, are missing calls; their sites stay, with the depths they have, or
    (`all_depths`) with those of the calls before any went missing.
    An allele number of `alleles` or more is an error. Null sample places are left out.
    """
    w = n_words(n)
    calls = calls.where(F.col("sample_idx").isNotNull())
    if not unique:
        least = F.min(F.struct(F.array("a1", "a2").alias("gt"), F.col("dp").alias("dp"))).alias("c")
        calls = calls.repartition("site_id").groupBy("site_id", "locus", "pos", "sample_idx").agg(least).select("site_id", "locus", "pos", "sample_idx", F.get("c.gt", F.lit(0)).alias("a1"), F.get("c.gt", F.lit(1)).alias("a2"), "c.dp")
    ok = F.coalesce(F.col("dp").between(*depth), F.lit(False)) if depth else F.lit(True)
    most = F.greatest("a1", "a2")
    a1, a2 = (F.when(ok, F.when(most >= alleles, F.raise_error(F.lit("an allele number without a plane")).cast("int")).otherwise(F.col(c))) for c in ("a1", "a2"))
    rows = calls.select("site_id", "locus", "pos", F.floor(F.col("sample_idx") / 64).cast("int").alias("w"), _bit(F.col("sample_idx") % 64).alias("b"), a1.alias("a1"), a2.alias("a2"), F.coalesce("a1", "a2").isNotNull().alias("known"), "dp")
    zero = F.lit(0).cast("long")
    called = F.col("a1").isNotNull() | F.col("a2").isNotNull()
    held = {f"p{a}": (F.col("a1") == a) | (F.col("a2") == a) for a in range(alleles)} | {"half": called & (F.col("a1").isNull() | F.col("a2").isNull())}
    dp = F.when(F.col("known") if all_depths else called, F.col("dp"))
    if w <= UNROLLED:
        words = [F.bit_or(F.when((F.col("w") == i) & F.coalesce(c, F.lit(False)), F.col("b")).otherwise(zero)).alias(f"{name}_{i}") for name, c in held.items() for i in range(w)]
        got = rows.groupBy("site_id", "locus", "pos").agg(*words, *_depth_columns(dp))
        sites = got.select("site_id", "locus", "pos", *[F.array(*[f"{name}_{i}" for i in range(w)]).alias(name) for name in held], *_DEPTHS)
    else:
        parts = rows.groupBy("site_id", "locus", "pos", "w").agg(*[F.bit_or(F.when(F.coalesce(c, F.lit(False)), F.col("b")).otherwise(zero)).alias(name) for name, c in held.items()], *_depth_columns(dp))
        got = parts.groupBy("site_id", "locus", "pos").agg(
            F.map_from_entries(F.collect_list(F.struct("w", F.struct(*held)))).alias("m"), F.min("dp_min").alias("dp_min"), F.max("dp_max").alias("dp_max"), F.sum("dp_sum").alias("dp_sum"), F.sum("dp_n").alias("dp_n")
        )
        line = lambda name: F.transform(F.sequence(F.lit(0), F.lit(w - 1)), lambda i: F.coalesce(F.try_element_at("m", i)[name], zero))
        sites = got.select("site_id", "locus", "pos", *[line(name).alias(name) for name in held], *_DEPTHS)
    return Planes(sites, n, alleles)


def from_packed(sites: DataFrame, n: int, alleles: int = 2) -> Planes:
    """Planes of packed sites, whose columns but calls are kept; each call is looked at once for each plane. An allele without a plane is an error."""
    w = n_words(n)
    zero = F.lit(0).cast("long")
    known = F.coalesce(F.array_max(F.flatten(F.transform("calls", lambda c: c["gt"]))) < alleles, F.lit(True))
    checked = sites.withColumn("calls", F.when(known, F.col("calls")).otherwise(F.raise_error(F.lit("an allele number without a plane")).cast(sites.schema["calls"].dataType)))

    def line(test: Callable[[Column], Column]) -> Column:
        bits = F.transform("calls", lambda c, i: F.when(F.coalesce(test(c), F.lit(False)), _bit(i % 64)).otherwise(zero))
        return F.transform(F.sequence(F.lit(0), F.lit(w - 1)), lambda k: F.aggregate(F.slice(bits, k * 64 + 1, F.lit(64)), zero, lambda s, x: s.bitwiseOR(x)))

    planes = {f"p{a}": line(lambda c, a=a: F.array_contains(c["gt"], a)) for a in range(alleles)}
    planes["half"] = line(lambda c: G.is_called(c["gt"]) & F.exists(c["gt"], lambda a: a.isNull()))
    depths = F.filter(F.transform(F.filter("calls", lambda c: G.is_called(c["gt"])), lambda c: c["dp"]), lambda d: d.isNotNull())
    above = F.filter(depths, lambda d: d > 0)
    numbers = {"dp_min": F.array_min(depths), "dp_max": F.array_max(depths), "dp_sum": F.when(F.size(above) > 0, F.aggregate(above, zero, lambda s, x: s + x)), "dp_n": F.size(above).cast("long")}
    return Planes(checked.withColumns(planes | numbers).drop("calls", "raw"), n, alleles)
