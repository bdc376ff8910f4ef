"""Export formats: code each genotype, gather per sample in site order, write text.

The transpose shuffles chunks: each task joins the codes of its sites per sample first, so rows of
samples x tasks travel, not of samples x sites.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import genotype as G
from ..sources.sides import small_side
from .filters import drop_autapomorphic
from .packed import by_place
from .stats import downsample, with_site_index


def collect_by_sample(calls: DataFrame, code: Column, missing: str, samples: DataFrame, sites: DataFrame, sep: str = "", chunk: int = 2000) -> DataFrame:
    """(sample_idx, sample, line): codes of each sample at all sites, in site order.

    `sites` has site_idx (consecutive) and site_id. Codes of `chunk` sites are joined first; the
    chunks of a sample then are put in order. Missing calls get `missing`; samples without any call
    have a line of missing codes. Repeated calls: the least code stays.
    """
    at = calls.join(sites.select("site_id", "site_idx"), "site_id").select("sample_idx", "site_idx", code.alias("code"))
    at = at.withColumn("block", F.floor(F.col("site_idx") / chunk)).withColumn("i", (F.col("site_idx") % chunk).cast("int"))
    blocks = by_place(at, ["sample_idx", "block"], "i", "code")
    widths = sites.groupBy(F.floor(F.col("site_idx") / chunk).alias("block")).agg(F.count(F.lit(1)).cast("int").alias("w"))
    grid = samples.select("sample_idx", "sample").crossJoin(small_side(widths))  # samples x blocks: dimensions, not calls
    full = grid.join(blocks, ["sample_idx", "block"], "left")
    part = F.array_join(F.transform(F.sequence(F.lit(0), F.col("w") - 1), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(missing))), sep)
    got = full.groupBy("sample_idx", "sample").agg(F.sort_array(F.collect_list(F.struct("block", part.alias("p")))).alias("ps"))
    return got.select("sample_idx", "sample", F.array_join(F.transform("ps", lambda x: x["p"]), sep).alias("line"))


def to_structure(calls: DataFrame, samples: DataFrame, sites: DataFrame, fast: bool = False) -> DataFrame:
    """Two lines per sample: allele + 1, -9 for missing, tab-separated, ordered by the samples' table.

    `fast`: five columns of the population before the sample's name.
    """
    # Both alleles go through one transpose, as pairs of codes that the two lines then take apart.
    pair = F.concat((F.col("a1") + 1).cast("string"), F.lit("/"), (F.col("a2") + 1).cast("string"))
    got = collect_by_sample(calls, pair, "-9/-9", samples, sites, "\t").join(small_side(samples.select("sample_idx", "pop")), "sample_idx")
    one = lambda i: F.regexp_replace("line", r"([-0-9]+)/([-0-9]+)", f"${i}")
    both = got.select("sample_idx", "sample", "pop", F.posexplode(F.array(one(1), one(2))).alias("hap", "line"))
    head = F.concat_ws("\t", *["pop"] * 5, "sample") if fast else F.concat_ws("\t", "sample", "pop")
    return both.select("sample_idx", "hap", F.concat_ws("\t", head, "line").alias("line"))


def to_newhybrids(calls: DataFrame, samples: DataFrame, sites: DataFrame) -> DataFrame:
    """Lines `i n  name<TAB>g g ...`: both allele numbers + 1 lumped, 0 for missing."""
    code = F.concat((F.col("a1") + 1).cast("string"), (F.col("a2") + 1).cast("string"))
    got = collect_by_sample(calls, code, "0", samples, sites, " ")
    return got.select("sample_idx", F.concat((F.col("sample_idx") + 1).cast("string"), F.lit(" n "), F.lit(" "), "sample", F.lit("\t"), "line").alias("line"))


def newhybrids_header(calls: DataFrame, samples: DataFrame, sites: DataFrame) -> list[str]:
    return [f"NumIndivs {samples.count()}", f"NumLoci {sites.count()}", "Digits 1", "Format Lumped"]


def to_nexus(calls: DataFrame, samples: DataFrame, sites: DataFrame, fmt: str = "snapp", rename: DataFrame | None = None) -> DataFrame:
    """Rows of a NEXUS matrix. snapp: dosage, ? for missing. splits: both sorted bases, ?? for missing.

    `splits` needs ref and alt in `calls`. `rename` (sample, label) gives labels where it has them.
    """
    if fmt == "snapp":
        code, missing = F.col("dosage").cast("string"), "?"
    else:
        base = lambda a: F.when(F.col(a) == 0, F.col("ref")).otherwise(F.col("alt"))
        code, missing = F.array_join(F.array_sort(F.array(base("a1"), base("a2"))), ""), "??"
    got = collect_by_sample(calls, code, missing, samples, sites)
    if rename is not None:
        got = got.join(small_side(rename), "sample", "left").withColumn("sample", F.coalesce("label", "sample"))
    return got.select("sample_idx", F.concat_ws("\t", "sample", "line").alias("line"))


def nexus_sites(calls: DataFrame, variable: bool = True, shared: bool = False, n: int | None = None, order: Column | None = None) -> DataFrame:
    """Numbered sites of a NEXUS matrix: those that vary, without autapomorphic ones (shared), and n of them at most.

    The n are those of least `order` (longs; by default a hash), ties by site_id, and stay in the order of site_id.
    """
    by = calls.groupBy("site_id").agg((F.min(F.least("a1", "a2")) != F.max(F.greatest("a1", "a2"))).alias("varies"))
    sites = by.where("varies").select("site_id") if variable else by.select("site_id")
    if shared:
        sites = sites.join(drop_autapomorphic(calls), "site_id", "left_semi")
    if n is not None:
        sites = downsample(sites, n, order)
    return with_site_index(sites.select("site_id"), "site_id")


def nexus_header(ntax: int, nchar: int, fmt: str = "snapp") -> list[str]:
    datatype = 'symbols="012" missing=?' if fmt == "snapp" else "datatype=DNA missing=? gap=-"
    return ["#NEXUS", "BEGIN DATA;", f"DIMENSIONS NTAX={ntax} NCHAR={nchar};", f"FORMAT {datatype};", "MATRIX"]


def _bases() -> Column:
    base = lambda a: F.when(F.col(a) == 0, F.col("ref")).when(F.col(a) == 1, F.col("alt")).otherwise("?")
    return F.array(base("a1"), base("a2"))


def to_svdquartets(calls: DataFrame, samples: DataFrame, sites: DataFrame, mode: str = "seq") -> DataFrame:
    """hap: two rows per sample, _A and _B, of one base each. seq: one row of IUPAC codes. - becomes . in names."""
    name = F.translate("sample", "-", ".")
    if mode == "seq":
        got = collect_by_sample(calls, G.iupac(_bases()), "?", samples, sites)
        return got.select("sample_idx", F.lit(0).alias("hap"), F.concat_ws("\t", name, "line").alias("line"))
    # Both haplotypes go through one transpose, as pairs of bases that the two rows then take apart.
    got = collect_by_sample(calls, F.array_join(_bases(), ""), "??", samples, sites)
    one = lambda i: F.struct(F.concat(name, F.lit("_" + "AB"[i])).alias("name"), F.regexp_replace("line", "(.)(.)", f"${i + 1}").alias("line"))
    return got.select("sample_idx", F.posexplode(F.array(one(0), one(1))).alias("hap", "x")).select("sample_idx", "hap", F.concat_ws("\t", "x.name", "x.line").alias("line"))


def taxon_sets(samples: DataFrame) -> DataFrame:
    """Lines `taxon : n1 n2 ...` of a partition block: places (from 1) of each taxon's samples."""
    places = F.array_join(F.transform(F.array_sort(F.collect_list("sample_idx")), lambda i: (i + 1).cast("string")), " ")
    return samples.groupBy("pop").agg(F.concat_ws(" : ", F.first("pop"), places).alias("line")).select("line")


def to_hyde(calls: DataFrame, samples: DataFrame, sites: DataFrame) -> DataFrame:
    """IUPAC rows ordered by taxon and name; ? for missing. The map file is sample and taxon."""
    got = collect_by_sample(calls, G.iupac(_bases()), "?", samples, sites)
    return got.join(small_side(samples.select("sample_idx", "pop")), "sample_idx").select("pop", "sample", F.concat_ws("\t", "sample", "line").alias("line"))


def to_fasta(calls: DataFrame, samples: DataFrame, sites: DataFrame) -> DataFrame:
    """Records of an alignment of IUPAC codes."""
    got = collect_by_sample(calls, G.iupac(_bases()), "?", samples, sites)
    return got.select("sample_idx", F.concat(F.lit(">"), "sample", F.lit("\n"), "line").alias("record"))


def to_beagle(sites: DataFrame) -> DataFrame:
    """Lines Marker Ref Alt and three likelihoods per sample, 4 decimals, from packed sites with pl; no shuffle."""
    three = F.flatten(F.transform("calls", lambda c: G.pl_to_likelihood(c["pl"])))
    text = F.array_join(F.transform(three, lambda x: F.format_string("%.4f", x)), "\t")
    return sites.select("site_idx", F.concat_ws("\t", "snp_id", F.get("alleles", F.lit(0)), F.get("alleles", F.lit(1)), text).alias("line"))


def to_treemix(counts: DataFrame, pops: list[str]) -> DataFrame:
    """Lines of ref,alt counts per population, from `population.allele_counts`."""
    return counts.select("site_id", F.concat_ws(" ", *[F.col(f"`{p}`") for p in pops]).alias("line"))


def to_geno(calls: DataFrame, samples: DataFrame, sites: DataFrame) -> DataFrame:
    """Rows of 0, 1, 2 with 9 for missing, samples x sites."""
    return collect_by_sample(calls, F.col("dosage").cast("string"), "9", samples, sites).select("sample_idx", "line")


def to_nexus_distances(pairs: DataFrame) -> DataFrame:
    """Lines of a square DISTANCES block; names with spaces are quoted; the diagonal is 0."""
    quoted = F.when(F.col("a").contains(" "), F.concat(F.lit("'"), "a", F.lit("'"))).otherwise(F.col("a"))
    both = pairs.select("a", "b", "dist").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "dist"))
    names = both.select("a").distinct()
    both = both.unionByName(names.select("a", F.col("a").alias("b"), F.lit(0.0).alias("dist")))
    row = F.transform(F.array_sort(F.collect_list(F.struct("b", "dist"))), lambda x: F.format_string("%.6f", x["dist"]))
    return both.groupBy("a").agg(F.array_join(row, " ").alias("row")).select("a", F.concat_ws(" ", quoted, "row").alias("line"))
