"""Aligned sequences: consensus, extraction of loci, diversity of alignments."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.genotype import HET_CODES, IUPAC, _map
from .filters import select_loci


def positions(seqs: DataFrame, *by: str) -> DataFrame:
    """One row per position (from 0) and sequence: c."""
    return seqs.select(*by, F.posexplode(F.split("seq", "")).alias("pos", "c")).where("c != ''")


def consensus(seqs: DataFrame, *by: str) -> DataFrame:
    """Consensus of the aligned sequences of each key.

    Position by position: all equal, that character. Else the code of the plain bases seen. Without
    plain bases the first other code (of the first sequence in `ord`, if given), and of gaps and N
    alone N if there is one.
    """
    first = F.col("ord") if "ord" in seqs.columns else F.lit(0)
    at = positions(seqs.withColumn("_o", first), *by, "_o")
    plain = F.array_sort(F.collect_set(F.when(F.col("c").isin("A", "C", "G", "T"), F.col("c"))))
    other = F.min_by("c", F.when(~F.col("c").isin("-", "N"), F.struct("_o", "c")))
    got = at.groupBy(*by, "pos").agg(plain.alias("bases"), F.min("c").alias("lo"), F.max("c").alias("hi"), other.alias("other"), F.bool_or(F.col("c") == "N").alias("any_n"), F.bool_or(~F.col("c").isin("-", "N")).alias("any_other"))
    code = F.when(F.col("lo") == F.col("hi"), F.col("lo")).when(F.size("bases") > 0, F.try_element_at(_map(IUPAC), F.array_join("bases", ""))).when(F.col("any_other"), F.col("other")).when(F.col("any_n"), "N").otherwise("-")
    return got.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", code.alias("c")))), lambda x: x["c"]), "").alias("seq"))


def extract_loci(seqs: DataFrame, loci: DataFrame, exclude: DataFrame | None = None, min_samples: int = 1) -> tuple[DataFrame, DataFrame]:
    """(one sequence per locus and sample, number of sequences per locus and sample).

    Two or more alleles of a sample become their consensus.
    """
    kept = select_loci(seqs, loci, exclude, min_samples)
    counts = kept.groupBy("locus", "sample").agg(F.count(F.lit(1)).alias("alleles"), F.any_value("seq").alias("seq"))
    single = counts.where("alleles = 1").select("locus", "sample", "seq")
    merged = consensus(kept.join(counts.where("alleles > 1").select("locus", "sample"), ["locus", "sample"], "left_semi"), "locus", "sample")
    return single.unionByName(merged.select("locus", "sample", "seq")), counts.select("locus", "sample", "alleles")


#: Codes of one-letter states: the bases that each stands for, by lower-case letter; what is not listed is another state.
_BASES = {v.lower(): ["acgt".index(x.lower()) for x in (k * 2 if len(k) == 1 else k)] for k, v in IUPAC.items() if v != "N"}


def _counted(chars: np.ndarray, cell: np.ndarray, cells: int) -> dict[str, np.ndarray]:
    """Counts of letters by column of an alignment (`cell` of each character): present, genotypes, ho, pi and whether it varies; columns without a present letter are NaN."""
    low = np.where((chars >= 65) & (chars <= 90), chars + 32, chars).astype(np.int64)
    known = ~np.isin(low, [ord(c) for c in "?n-"])
    letters, code = np.unique(low[known], return_inverse=True)
    count = np.bincount(cell[known] * max(1, len(letters)) + code, minlength=cells * max(1, len(letters))).reshape(cells, max(1, len(letters)))
    names = [chr(x) for x in letters]
    base = np.zeros((cells, 4), np.int64)
    for j, c in enumerate(names):
        for b in _BASES.get(c, ()):
            base[:, b] += count[:, j]
    present = count.sum(1)
    het = count[:, [c in HET_CODES for c in names]].sum(1) if names else present
    total = base.sum(1)
    with np.errstate(invalid="ignore", divide="ignore"):
        pi = np.where(total > 1, 1 - (base * (base - 1)).sum(1) / (total * (total - 1.0)), np.nan) * 2 * present / (2 * present - 1)
        ho = het / present
    genotypes = (count > 0).sum(1)
    return {"present": present, "genotypes": genotypes, "ho": ho, "pi": pi, "varies": (genotypes > 1) | (het > 0)}


def _by_locus(seqs: DataFrame, made: Callable[[list, np.ndarray, np.ndarray, np.ndarray, dict], pd.DataFrame], schema: str) -> DataFrame:
    """Rows that `made` makes of whole loci: their names, numbers of samples and of columns, the first column's place of each, and `_counted`.

    Sequences of a locus meet in one task, sorted by locus and sample; their letters become one array of bytes for many
    loci at once, counted by column. What a batch leaves of its last locus is put before the next one.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = None
        for pdf in batches:
            pdf = pdf if left is None else pd.concat([left, pdf], ignore_index=True)
            last = pdf.locus.iat[-1]
            open_ = (pdf.locus == last).to_numpy()
            left, pdf = pdf[open_], pdf[~open_]
            if len(pdf):
                yield counted(pdf)
        if left is not None and len(left):
            yield counted(left)

    def counted(pdf: pd.DataFrame) -> pd.DataFrame:
        code, loci = pd.factorize(pdf.locus)
        text = [s.encode("latin-1", "replace") for s in pdf.seq]
        length = np.fromiter(map(len, text), np.int64, len(text))
        width = np.zeros(len(loci), np.int64)
        np.maximum.at(width, code, length)
        first = np.r_[0, np.cumsum(width)]
        cell = np.repeat(first[code], length) + np.arange(int(length.sum())) - np.repeat(np.r_[0, np.cumsum(length)[:-1]], length)
        people, known = pd.factorize(pdf["sample"])
        samples = np.bincount(np.unique(code[people >= 0] * np.int64(len(known) + 1) + people[people >= 0]) // (len(known) + 1), minlength=len(loci))
        return made(list(loci), samples, width, first, _counted(np.frombuffer(b"".join(text), np.uint8), cell, int(first[-1])))

    rows = seqs.where("locus is not null and seq is not null").select("locus", "sample", "seq")
    return rows.repartition("locus").sortWithinPartitions("locus", "sample").mapInPandas(run, schema)


def site_diversity(seqs: DataFrame, n_samples: int) -> DataFrame:
    """Per locus and position: present, genotypes, ho, pi (unbiased) and whether it varies; positions without a present letter are left out.

    Lower-case codes; ? n and - are missing. pi: 1 - sum of C(n_i, 2) / C(n, 2) over the bases that
    the codes stand for, times 2 m / (2 m - 1) for m present samples.
    """

    def made(loci, samples, width, first, c) -> pd.DataFrame:
        out = pd.DataFrame({"locus": np.repeat(np.array(loci, object), width), "pos": np.arange(first[-1]) - np.repeat(first[:-1], width), **c})
        return out[out.present > 0]

    kind = seqs.schema["locus"].dataType.simpleString()
    got = _by_locus(seqs, made, f"locus {kind}, pos int, present long, genotypes long, ho double, pi double, varies boolean")
    return got.withColumn("pi", F.nanvl("pi", F.lit(None).cast("double")))


def alignment_diversity(seqs: DataFrame, n_samples: int) -> DataFrame:
    """Per locus: samples, sites, polymorphic, missing %, and Ho, pi and Fis weighted by presence; no row for a position and sample."""

    def made(loci, samples, width, first, c) -> pd.DataFrame:
        owner = np.repeat(np.arange(len(loci)), width)
        add = lambda v: np.bincount(owner, weights=v, minlength=len(loci))
        w, ho, pi = c["present"], np.nan_to_num(c["ho"]), c["pi"]
        fis_ok = np.nan_to_num(pi) > 0
        fis = np.where(fis_ok, (pi - ho) / np.where(fis_ok, pi, 1), 0)
        mean = lambda v, ok: np.divide(add(np.where(ok, np.nan_to_num(v) * w, 0)), add(np.where(ok, w, 0)), out=np.full(len(loci), np.nan), where=add(np.where(ok, w, 0)) > 0)
        cells = add(w)
        return pd.DataFrame({
            "locus": loci, "samples": samples, "sites": width, "polymorphic": add(c["varies"]).astype(np.int64),
            "missing_percent": 100 * (1 - np.divide(cells, width * n_samples, out=np.full(len(loci), np.nan), where=width > 0)), "ho": mean(ho, w > 0), "pi": mean(pi, ~np.isnan(pi)), "fis": mean(fis, fis_ok),
        })

    kind = seqs.schema["locus"].dataType.simpleString()
    got = _by_locus(seqs, made, f"locus {kind}, samples long, sites int, polymorphic long, missing_percent double, ho double, pi double, fis double")
    clear = lambda c: F.nanvl(c, F.lit(None).cast("double")).alias(c)
    return got.select("locus", "samples", "sites", "polymorphic", *map(clear, ("missing_percent", "ho", "pi", "fis")))


def alignment_by_sample(seqs: DataFrame) -> DataFrame:
    """Per sample: loci and sites where present, heterozygous and missing sites, and Ho.

    Ho: sum of the loci's shares of heterozygous sites over the number of loci with sequence.
    """
    low = F.lower("seq")
    het, known, all_ = F.length(F.regexp_replace(low, "[^kmrswybdhv]", "")), F.length(F.regexp_replace(low, "[?n-]", "")), F.length(low)
    per = seqs.select("sample", het.alias("het"), known.alias("known"), all_.alias("all"))
    return per.groupBy("sample").agg(F.count(F.lit(1)).alias("loci"), F.sum("all").alias("sites"), F.sum("het").alias("polymorphic"), F.sum(F.when(F.col("known") > 0, F.col("all") - F.col("known")).otherwise(0)).alias("missing"), (F.sum(F.col("het") / F.nullif("known", F.lit(0))) / F.count(F.lit(1))).alias("ho"))


def mean_se(df: DataFrame, *columns: str) -> DataFrame:
    """One row: mean and standard error of columns."""
    se: list[Column] = []
    for c in columns:
        se += [F.avg(c).alias(c), F.sqrt(F.var_samp(c) / F.count(c)).alias(f"{c}_se")]
    return df.agg(*se)
