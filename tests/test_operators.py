"""Rules of operators on small hand-made tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusframe.operators import filters as FI
from locusframe.operators import isolation as I
from locusframe.operators import loci as L
from locusframe.operators import ordination as O
from locusframe.operators import packed as P
from locusframe.operators import pairs as PA
from locusframe.operators import population as PO
from locusframe.operators import replicates as R
from locusframe.operators import runs as RU
from locusframe.operators import stats as S


def packed(spark, *rows):
    """Sites from lists of genotypes such as '01' or '..'."""
    data = [(i, 0, i, [([None if a == "." else int(a) for a in g], 5) for g in r]) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "site_id long, locus long, pos int, calls array<struct<gt:array<int>,dp:int>>")


def test_three_rules_of_monomorphic(spark):
    sites = packed(spark, ["01", "01"], ["00", "00"], ["00", ".."], ["01", "10"], ["00", "01"], ["..", ".."])
    kept = lambda rule: [r["site_id"] for r in sites.where(P.polymorphic(rule)).orderBy("site_id").collect()]
    assert kept("genotypes") == [4]
    assert kept("all_states") == [4]
    assert kept("alleles") == [0, 3, 4]


def test_depth_rules_without_depths(spark):
    sites = spark.createDataFrame([(1, [([0, 1], None)])], "site_id long, calls array<struct<gt:array<int>,dp:int>>")
    row = sites.select(P.max_depth(5).alias("a"), P.min_depth(0).alias("b"), P.max_mean_depth(5).alias("c"), P.min_mean_depth(0).alias("d")).first()
    assert tuple(row) == (True, False, False, False)


def test_mac_ignores_other_alleles(spark):
    sites = packed(spark, ["12", "02"])
    assert sites.where(P.min_mac(1)).count() == 1 and sites.where(P.min_mac(2)).count() == 0


def test_packed_and_long_agree(spark):
    sites = packed(spark, ["01", "..", "11"], ["00", "01", ".."])
    samples = spark.createDataFrame([(i, f"s{i}", "p") for i in range(3)], "sample_idx int, sample string, pop string")
    long = P.to_long(sites, samples)
    again = P.to_packed(long.select("*"), 3).orderBy("site_id").collect()
    assert [[c["gt"] for c in r["calls"]] for r in again] == [[[0, 1], [None, None], [1, 1]], [[0, 0], [0, 1], [None, None]]]
    assert P.to_packed(long.where("false"), 3).count() == 0


def test_blocks_equal_the_join(spark):
    rng = random.Random(3)
    rows = [["..", "00", "01", "11"][rng.randrange(4)] for _ in range(60 * 6)]
    sites = packed(spark, *[rows[i * 6 : i * 6 + 6] for i in range(60)])
    samples = spark.createDataFrame([(i, f"s{i}", "p") for i in range(6)], "sample_idx int, sample string, pop string")
    long = P.to_long(sites, samples)
    block = {(r["a"], r["b"]): r for r in PA.block_distances(sites.repartition(3), [f"s{i}" for i in range(6)], "mismatch", "divergence", "missing").collect()}
    for r in PA.genotype_mismatch(long).collect():
        assert block[r["a"], r["b"]]["mismatch"] == pytest.approx(r["dist"])
    for r in PA.missing_mismatch(long).collect():
        assert block[r["a"], r["b"]]["missing"] == pytest.approx(r["dist"])


def test_hamming_equals_brute_force(spark):
    rng = random.Random(5)
    tags = ["".join(rng.choice("ACGT") for _ in range(69)) for _ in range(60)]
    for i in range(0, 60, 6):
        t = list(tags[i])
        for p in rng.sample(range(5, 69), rng.choice([3, 9, 10])):
            t[p] = "ACGT"[("ACGT".index(t[p]) + 1) % 4]
        tags.append("".join(t))
    rows = [(i, t) for i, t in enumerate(tags)]
    got = {r["locus"] for r in FI.filter_hamming(spark.createDataFrame(rows, "locus long, seq string")).collect()}
    near = lambda a, b: sum(x != y for x, y in zip(a[5:], b[5:])) <= 9
    assert got == {i for i, t in rows if not any(near(t, u) for u in tags[:i])}


def test_clone_groups_of_a_chain(spark):
    rows = [(f"s{i:02d}", f"s{i + 1:02d}", 0.01) for i in range(11)] + [("x", "y", 0.01), ("x", "s00", 0.5)]
    pairs = spark.createDataFrame(rows, "a string, b string, dist double")
    got = {r["sample"]: r["clone_group"] for r in PA.clone_groups(pairs).collect()}
    assert set(got.values()) == {"s00", "x"} and got["s11"] == "s00"
    assert PA.clone_groups(pairs.where("false")).count() == 0


def test_classes_of_pairs(spark):
    reps = spark.createDataFrame([("a", "b"), ("c", "d")], "sample_a string, sample_b string")
    pairs = spark.createDataFrame([("b", "a", 0.2), ("c", "d", 0.01), ("a", "c", 0.05), ("e", "a", 0.05), ("e", "f", 0.4), ("e", "g", 0.1)], "a string, b string, dist double")
    got = {(r["a"], r["b"]): r["class"] for r in R.classify_pairs(pairs, reps, 0.1).collect()}
    assert got == {("a", "b"): "rep_above", ("c", "d"): "rep_ok", ("a", "c"): "rep_below", ("a", "e"): "possible_clone", ("e", "f"): "high", ("e", "g"): "high"}


def test_replicate_names(spark):
    s = spark.createDataFrame([("x1",), ("x1_R",), ("y22",), ("y2_R1",), ("z1",), ("z2",), ("z_R",)], "sample string")
    assert {tuple(r) for r in R.replicate_pairs(s).collect()} == {("x1", "x1_R"), ("y22", "y2_R1")}


def test_consensus_rules(spark):
    rows = [("L", "a", "AAR-N-AT"), ("L", "b", "ACRNN-CT"), ("L", "c", "AAY--NGT")]
    seqs = spark.createDataFrame(rows, "locus string, sample string, seq string").withColumn("ord", F.col("sample"))
    assert L.consensus(seqs, "locus").first()["seq"] == "AMRNNNVT"


def test_extract_loci(spark):
    seqs = spark.createDataFrame([("1", "s", "AC"), ("1", "s", "AT"), ("1", "t", "AC"), ("2", "s", "GG"), ("3", "s", "TT")], "locus string, sample string, seq string")
    ids = spark.createDataFrame([("1",), ("2",)], "id string")
    one, counts = L.extract_loci(seqs, ids, min_samples=2)
    assert {tuple(r) for r in one.select("locus", "sample", "seq").collect()} == {("1", "s", "AY"), ("1", "t", "AC")}
    assert {tuple(r) for r in counts.collect()} == {("1", "s", 2), ("1", "t", 1)}


def test_nei_by_hand(spark):
    sp = spark.createDataFrame([(1, 1, "p", 4, 4, 1, 2, 1), (2, 1, "p", 1, 0, 1, 0, 0)], "site_id long, locus long, pop string, n long, alt long, x0 long, x1 long, x2 long")
    rows = PO.nei(sp).orderBy("site_id").collect()
    assert rows[0]["ho"] == 0.5 and rows[0]["hs"] == pytest.approx(4 / 3 * (0.5 - 0.5 / 8)) and rows[1]["hs"] is None


def test_evanno_and_best(spark):
    runs = spark.createDataFrame([(1, 1, -10.0), (1, 2, -12.0), (2, 3, -5.0), (2, 4, -7.0), (3, 5, -5.0), (3, 6, -5.0)], "k int, run long, likelihood double")
    rows = RU.evanno(runs).orderBy("k").collect()
    assert rows[1]["lprime"] == 5.0 and rows[1]["abs_ldprime"] == 4.0 and rows[1]["delta_k"] == pytest.approx(4 / 2**0.5) and rows[2]["delta_k"] is None
    best = RU.best_per_k(runs.withColumn("score", -F.col("likelihood"))).orderBy("k").collect()
    assert [r["run"] for r in best] == [1, 3, 5]


def test_regression_p(spark):
    pairs = spark.createDataFrame([(float(x), y) for x, y in enumerate([1.0, 2.1, 2.9, 4.2, 4.8])], "km double, dist double")
    row = I.ibd_regression_p(pairs).first()
    t = np.sqrt(3 * row["r2"] / (1 - row["r2"]))
    u = t / np.sqrt(3)  # Student's t with three degrees of freedom has a closed form
    assert row["slope"] == pytest.approx(0.97) and row["p"] == pytest.approx(1 - 2 / np.pi * (u / (1 + u * u) + np.arctan(u)), rel=1e-9)


def test_pca_separates(spark):
    sites = packed(spark, *([["00", "00", "11", "11"]] * 5 + [["00", "01", "00", "01"]]))
    rows = O.pca(sites.repartition(2), list("abcd"), 1).orderBy("sample").collect()
    score = [r["score"] for r in rows]
    assert np.sign(score[0]) == np.sign(score[1]) != np.sign(score[2]) == np.sign(score[3])


def test_downsample_is_exact_and_repeatable(spark):
    sites = spark.range(100).withColumnRenamed("id", "site_id")
    a, b = (sorted(r["site_id"] for r in S.downsample(sites, 10, seed=4).collect()) for _ in range(2))
    assert len(a) == 10 and a == b and S.downsample(sites, 1000).count() == 100


def test_pop_filters(spark):
    calls = spark.createDataFrame([("aZ", "p1", 1), ("b", None, 1), ("c", "q2", 1)], "sample string, pop string, site_id int")
    assert {r["sample"] for r in FI.drop_pops(calls, ["q2"]).collect()} == {"aZ", "b"}
    assert {r["sample"] for r in FI.drop_outgroups(calls).collect()} == {"b", "c"}
    assert {r["sample"] for r in FI.keep_pops_like(calls, "^p").collect()} == {"aZ"}
