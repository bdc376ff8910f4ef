"""Column expressions for calls, alleles and bases; all of them run inside Spark."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# IUPAC codes of sets of bases.
IUPAC = {
    "A": "A", "C": "C", "G": "G", "T": "T", "AC": "M", "AG": "R", "AT": "W", "CG": "S", "CT": "Y", "GT": "K",
    "ACG": "V", "ACT": "H", "AGT": "D", "CGT": "B", "ACGT": "N",
}
#: Usual texts of genotypes of two alleles, with their allele numbers: looked up, others are taken apart.
USUAL_GT = {f"{a}{sep}{b}": [None if x == "." else int(x) for x in (a, b)] for sep in "/|" for a in "01." for b in "01."}
HET_CODES = ("k", "m", "r", "s", "w", "y", "b", "d", "h", "v")


def _map(pairs: dict) -> Column:
    value = lambda v: F.array(*map(F.lit, v)) if isinstance(v, (list, tuple)) else F.lit(v)
    return F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), value(v))])


def parse_gt(call: Column) -> Column:
    """Allele numbers of a call such as 0|1:20; a dot is null. Phased and unphased read alike."""
    return gt_alleles(F.substring_index(call, ":", 1))


def gt_alleles(text: Column) -> Column:
    """Allele numbers of the genotype of a call, the text before the first colon."""
    number = lambda a: F.lit(a).cast("int")
    usual = F.create_map(*[x for k, v in USUAL_GT.items() for x in (F.lit(k), F.array(*map(number, v)))])
    return F.coalesce(F.try_element_at(usual, text), F.transform(F.split(F.translate(text, "|", "/"), "/"), lambda a: number_of(a, "int")))


def number_of(text: Column, kind: str) -> Column:
    """The number a text gives; a dot and what is no number are null. A cast that fails costs an exception, so dots, which are frequent, are not cast."""
    return F.nullif(text, F.lit(".")).try_cast(kind)


def is_called(gt: Column, rule: str = "any") -> Column:
    """`any`: one allele is known (a half call counts). `all`: no allele is missing (exports)."""
    known = lambda a: a.isNotNull()
    return F.coalesce(F.exists(gt, known) if rule == "any" else F.forall(gt, known) & (F.size(gt) > 0), F.lit(False))


def format_field(call: Column, fmt: Column, key: str) -> Column:
    """The value of a FORMAT key in a call, wherever the key stands; null if absent."""
    at = F.array_position(fmt, key)
    return F.when(at > 0, F.get(F.split(call, ":"), (at - 1).cast("int")))


def info_number(info: Column) -> Column:
    """NS of an INFO map, AN where there is no NS; null if neither is there."""
    return F.coalesce(info["NS"].try_cast("int"), info["AN"].try_cast("int"))


def dosage(gt: Column) -> Column:
    """Number of ALT alleles; null if any allele is missing."""
    return F.when(is_called(gt, "all"), F.aggregate(gt, F.lit(0), lambda s, a: s + a))


def genotype_key(gt: Column) -> Column:
    """Sorted allele numbers joined, e.g. 01; NA if nothing is called."""
    return F.when(is_called(gt), F.array_join(F.array_sort(gt), "", ".")).otherwise("NA")


def to_bases(gt: Column, alleles: Column) -> Column:
    """Bases of a call; ? for a missing allele and for a deletion (*)."""
    base = lambda a: F.get(alleles, a)
    return F.transform(gt, lambda a: F.when(a.isNull() | (base(a) == "*"), "?").otherwise(F.coalesce(base(a), F.lit("?"))))


def iupac(bases: Column) -> Column:
    """Code of a call's bases. With ? beside a base: the base; nothing but ?: ?."""
    known = F.array_sort(F.array_distinct(F.filter(bases, lambda b: b != "?")))
    return F.coalesce(F.try_element_at(_map(IUPAC), F.array_join(known, "")), F.lit("?"))


def iupac_expand(code: Column) -> Column:
    """Bases of a lower-case code: twice the base for a plain one, two or three for others."""
    table = {v.lower(): [x.lower() for x in (k * 2 if len(k) == 1 else k)] for k, v in IUPAC.items() if v != "N"}
    return F.try_element_at(_map(table), code)


def is_het_code(code: Column) -> Column:
    """Whether a lower-case code stands for several bases."""
    return code.isin(*HET_CODES)


def pl_to_likelihood(pl: Column) -> Column:
    """10 ** (-PL / 10), scaled to sum 1; a third each where PL is missing."""
    raw = F.transform(pl, lambda x: F.pow(F.lit(10.0), -x / 10))
    total = F.aggregate(raw, F.lit(0.0), lambda s, x: s + x)
    third = F.array(*[F.lit(1.0) / 3] * 3)
    return F.when(pl.isNull() | (F.size(pl) != 3) | F.exists(pl, lambda x: x.isNull()), third).otherwise(F.transform(raw, lambda x: x / total))


def locus_of(snp_id: Column) -> Column:
    """Part of a SNP's name before the first underscore."""
    return F.regexp_replace(snp_id, "_.*", "")


def replicate_base(sample: Column, marker: str = "_R") -> Column:
    """Name of a sample without the mark of a replicate and what follows it."""
    return F.regexp_replace(sample, f"{marker}.*", "")
