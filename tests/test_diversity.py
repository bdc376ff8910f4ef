"""Tables of diversity on hand-made calls."""

import pytest

from locusframe.operators import diversity as D
from locusframe.operators import exports as X

CALLS = "site_id long, locus long, sample string, pop string, a1 int, a2 int, dosage int"
PEOPLE = [("a", "p"), ("b", "p"), ("c", "q"), ("d", "q"), ("e", None)]


def calls(spark, rows):
    pops = dict(PEOPLE)
    return spark.createDataFrame([(s, l, x, pops[x], d // 2, d - d // 2, d) for s, l, x, d in rows], CALLS)


def test_autosomal_table(spark):
    people = spark.createDataFrame(PEOPLE, "sample string, pop string")
    # p: complete at sites 1, 2 (locus 1) and 3 (locus 2, no variation); q is complete nowhere.
    rows = [(1, 1, "a", 1), (1, 1, "b", 0), (2, 1, "a", 1), (2, 1, "b", 1), (3, 2, "a", 0), (3, 2, "b", 0), (4, 3, "a", 1), (4, 3, "c", 2), (1, 1, "e", 2)]
    invariant = spark.createDataFrame([(None, 3)], "taxon string, invariant long")
    got = {r["pop"]: r for r in D.autosomal_table(calls(spark, rows), people, invariant).collect()}
    p, q = got["p"], got["q"]
    assert set(got) == {"p", "q"} and (p["samples"], p["loci_auto"], p["snps"], p["unlinked_snps"]) == (2, 2, 3, 1)
    # Two of three loci: 3 * 2 / 3 invariant sites beside 3 others; values .5, 1, 0, 0, 0.
    assert p["ho_auto"] == pytest.approx(0.3) and p["ho_auto_se"] == pytest.approx((0.8 / 4 / 5) ** 0.5)
    assert p["ho_snp"] in (0.5, 1.0) and p["ho_snp_se"] is None
    assert (q["snps"], q["unlinked_snps"], q["ho_auto"], q["fis"]) == (0, 0, None, None)
    none = D.autosomal_table(calls(spark, []), people.limit(0), invariant)
    assert none.count() == 0 and none.columns == list(p.asDict())


def test_taxa_drop_their_invariant_sites(spark):
    people = spark.createDataFrame(PEOPLE, "sample string, pop string")
    rows = [(1, 1, "a", 1), (1, 1, "b", 0), (1, 1, "c", 0), (1, 1, "d", 0), (2, 2, "c", 2), (2, 2, "d", 0)]
    taxa = spark.createDataFrame([("p", "s"), ("q", "t")], "pop string, taxon string")
    invariant = spark.createDataFrame([("s", 1)], "taxon string, invariant long")
    got = {r["pop"]: r for r in D.autosomal_table(calls(spark, rows), people, invariant, taxa).collect()}
    assert got["p"]["snps"] == 1 and got["p"]["ho_auto"] == pytest.approx(0.25)
    assert got["q"]["snps"] == 1 and got["q"]["he_auto"] == pytest.approx(0.5)  # site 1 does not vary in t, which has no invariant loci


def test_alignment_table(spark):
    people = spark.createDataFrame(PEOPLE, "sample string, pop string")
    seqs = spark.createDataFrame([("1", "a", "AR"), ("1", "b", "AA"), ("2", "a", "C-"), ("1", "c", "??"), ("1", "e", "TT")], "locus string, sample string, seq string")
    got = {r["pop"]: r for r in D.alignment_table(seqs, people).collect()}
    p = got["p"]
    assert (p["loci"], p["sites"], p["polymorphic"], p["samples"]) == (2, 4, 1, 1.5)
    assert p["missing_percent"] == pytest.approx((0 + 75) / 2) and p["ho"] == pytest.approx((0.25 + 0) / 2)
    assert p["samples_loci"] == 1.5 and p["samples_missing"] == pytest.approx(12.5)
    assert got["q"]["missing_percent"] == 100 and got["q"]["ho"] is None
    assert D.alignment_table(seqs.limit(0), people).count() == 0


def test_nexus_sites(spark):
    rows = [(5, 1, "a", 1), (5, 1, "b", 0), (5, 1, "c", 1), (5, 1, "d", 0), (7, 1, "a", 0), (7, 1, "c", 0), (9, 2, "a", 1), (9, 2, "b", 0), (9, 2, "c", 0)]
    c = calls(spark, rows)
    pick = lambda **k: [(r["site_id"], r["site_idx"]) for r in X.nexus_sites(c, **k).orderBy("site_idx").collect()]
    assert pick() == [(5, 0), (9, 1)] and pick(shared=True) == [(5, 0)] and pick(variable=False) == [(5, 0), (7, 1), (9, 2)]
    from pyspark.sql import functions as F

    assert pick(n=1, order=-F.col("site_id")) == [(9, 0)] and pick(n=0) == []
