"""Planes of bits, tiles of samples, exact selection and iterations against plain Python."""

import os
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusframe.operators import filters as FI
from locusframe.operators import isolation as I
from locusframe.operators import loci as L
from locusframe.operators import ordination as O
from locusframe.operators import packed as P
from locusframe.operators import pairs as PA
from locusframe.operators import planes as PL
from locusframe.operators import select as SE
from locusframe.operators import stats as S
from locusframe.operators import tiles as TI
from locusframe.plans import queries as Q

CALLS = "site_id long, locus long, pos int, sample_idx int, sample string, a1 int, a2 int, dosage int, dp int"


def random_calls(sites, n, alleles=2, half=True, seed=1, share=0.7):
    rng, rows = random.Random(seed), []
    for s in range(sites):
        for i in range(n):
            if rng.random() < share:
                g = [rng.randrange(alleles), rng.randrange(alleles)]
                if half and rng.random() < 0.1:
                    g[rng.randrange(2)] = None
                d = None if None in g else sum(g)
                rows.append((s, s // 4, s % 4, i, f"s{i}", *g, d, rng.choice([None, 0, 3, 7, 20, 90])))
    return rows


@pytest.mark.parametrize("n, alleles", [(5, 2), (64, 2), (70, 3), (600, 2)])
def test_predicates_of_planes_equal_those_of_arrays(spark, monkeypatch, n, alleles):
    rows = random_calls(24, n, alleles, seed=n, share=0.05 if n > 99 else 0.6)
    rows += [(100, 25, 0, 0, "s0", 0, 0, 0, 5), (101, 25, 1, n - 1, f"s{n - 1}", 1, 1, 2, None)]
    calls = spark.createDataFrame(rows, CALLS)
    pops = ["pq"[i % 2] if i % 5 else None for i in range(n)]
    packed = P.to_packed(calls, n)
    rules = [("call", P.min_call_rate, 0.3), ("mac", P.min_mac, 2), ("maf", P.min_maf, 0.3), ("maf", P.min_maf, 3), ("min", P.min_depth, 1), ("max", P.max_depth, 20), ("mean", P.min_mean_depth, 9.0), ("mean", P.max_mean_depth, 9.0)]
    want = {"n": P.n_called(), "a0": P.allele_count(0), "a1": P.allele_count(1), "md": P.mean_depth(), "any": P.any_called(), "dep": P.any_depth(), "req": P.require_pops(pops, ["p", "q"]), "per": P.min_per_pop(pops, 2), "pops": P.min_pops(pops, 2)}
    want |= {f"{k}{i}": f(x) for i, (k, f, x) in enumerate(rules)} | {r: P.polymorphic(r) for r in ("genotypes", "all_states", "alleles")}
    expected = {r["site_id"]: r.asDict() for r in packed.select("site_id", *[c.alias(k) for k, c in want.items()], *[c.alias(f"st{i}") for i, c in enumerate(P.site_stats())]).collect()}
    for planes in (PL.from_calls(calls, n, alleles), PL.from_calls(calls, n, alleles, unique=True), PL.from_packed(packed, n, alleles)):
        got = {"n": planes.n_called(), "a0": planes.allele_count(0), "a1": planes.allele_count(1), "md": planes.mean_depth(), "any": planes.any_called(), "dep": planes.any_depth(), "req": planes.require_pops(pops, ["p", "q"]), "per": planes.min_per_pop(pops, 2), "pops": planes.min_pops(pops, 2)}
        got |= {f"{k}{i}": getattr(planes, f.__name__)(x) for i, (k, f, x) in enumerate(rules)} | {r: planes.polymorphic(r) for r in ("genotypes", "all_states", "alleles")}
        found = {r["site_id"]: r.asDict() for r in planes.sites.select("site_id", *[c.alias(k) for k, c in got.items()], *[c.alias(f"st{i}") for i, c in enumerate(planes.site_stats())]).collect()}
        assert found.keys() == expected.keys()
        for s in expected:
            assert found[s] == pytest.approx(expected[s]), s


def test_repeats_masks_and_errors_of_planes(spark):
    rows = [(1, 0, 0, 0, "a", 1, 1, 2, 5), (1, 0, 0, 0, "a", 0, 1, 1, 9), (1, 0, 0, 1, "b", 1, 1, 2, None), (2, 0, 1, None, None, 0, 0, 0, 1), (2, 0, 1, 1, "b", 0, 0, 0, 50)]
    calls = spark.createDataFrame(rows, CALLS)
    p = PL.from_calls(calls, 2)
    assert {r["site_id"]: (r["p0"], r["p1"]) for r in p.sites.collect()} == {1: ([1], [3]), 2: ([2], [0])}
    masked = PL.from_calls(calls, 2, depth=(10, 60))
    assert {r["site_id"]: r["n"] for r in masked.sites.select("site_id", masked.n_called().alias("n")).collect()} == {1: 0, 2: 1}
    kept = p.keep([1])
    assert {r["site_id"]: r["n"] for r in kept.sites.select("site_id", kept.n_called().alias("n")).collect()} == {1: 1, 2: 1}
    with pytest.raises(Exception, match="without a plane"):
        PL.from_calls(spark.createDataFrame([(1, 0, 0, 0, "a", 2, 0, 2, 1)], CALLS), 2).sites.collect()
    counts, sites = p.called_per_sample()
    assert (counts, sites) == ([1, 2], 2) and PL.from_calls(calls.where("false"), 2).called_per_sample() == ([0, 0], 0)


def sums_by_hand(rows, n):
    at = {(r[0], r[3]): r[7] for r in rows if r[7] is not None}
    sites = {r[0] for r in rows}
    out = {}
    for i in range(n):
        for j in range(i + 1, n):
            both = [(at[s, i], at[s, j]) for s in sites if (s, i) in at and (s, j) in at]
            if both:
                out[i, j] = (len(both), sum(a == b for a, b in both), sum(abs(a - b) for a, b in both), sum((a - b) ** 2 for a, b in both), sum(((s, i) in at) != ((s, j) in at) for s in sites))
    return out


@pytest.mark.parametrize("tile", [None, 7, 4, 1])
def test_tiles_equal_loops(spark, tile):
    rows = random_calls(60, 9, seed=3)
    got = PA.call_sums(spark.createDataFrame(rows, CALLS).repartition(3), names=[f"s{i}" for i in range(9)], tile=tile).collect()
    assert {(int(r["a"][1:]), int(r["b"][1:])): tuple(int(r[k]) for k in TI.Dosages.names) for r in got} == sums_by_hand(rows, 9)
    # Segments: each half of the sites by itself.
    by = PA.call_sums(spark.createDataFrame(rows, CALLS).withColumn("half", F.when(F.col("site_id") < 30, "lo").otherwise("hi")), "half", names=[f"s{i}" for i in range(9)], tile=tile).collect()
    for h, own in (("lo", [r for r in rows if r[0] < 30]), ("hi", [r for r in rows if r[0] >= 30])):
        assert {(int(r["a"][1:]), int(r["b"][1:])): tuple(int(r[k]) for k in TI.Dosages.names) for r in by if r["half"] == h} == sums_by_hand(own, 9)
    assert PA.call_sums(spark.createDataFrame([], CALLS), names=["s0", "s1"], tile=tile).count() == 0


def test_many_samples_by_tiles(spark):
    """More samples than a tile holds, and more words than are written out; the last 64 samples alone have calls, so sums are few."""
    n, few = 1500, 64
    rows = [(s, 0, 0, n - few + i, f"s{i}", *a) for s, _, _, i, _, *a in random_calls(6, few, half=False, seed=5)]
    kernel = TI.Dosages()
    bits = TI.bit_rows(spark.createDataFrame(rows, CALLS), ["site_id"], kernel.planes, n)

    got = TI.pair_sums(bits, [], kernel, n, 512).where("shared > 0")
    assert {(r["i"] - n + few, r["j"] - n + few): tuple(int(r[k]) for k in kernel.names) for r in got.collect()} == sums_by_hand([(*r[:3], r[3] - n + few, *r[4:]) for r in rows], few)


def test_matchstates_worked_example(spark):
    """A against A, A against AG, AG against AG, A against G, AG against AC (joined), AG against CT."""
    pair = {"same": ((0, 0), (0, 0), 0, 0), "half": ((0, 0), (0, 1), 0.5, 0.25), "hets": ((0, 1), (1, 0), 0, 0), "apart": ((0, 0), (1, 1), 1, 1), "one": ((0, 1), (0, 2), 0.5, 0.5), "none": ((0, 1), (2, 3), 1, 1)}
    for x, y, g, m in pair.values():
        rows = [(1, 0, 0, 0, "x", *x, sum(x), 1), (1, 0, 0, 1, "y", *y, sum(y), 1)]
        calls = spark.createDataFrame(rows, CALLS)
        assert PA.allele_set_distance(calls).first()["dist"] == pytest.approx(g)
        assert PA.allele_set_distance(calls, kind=PA.MATCHSTATES).first()["dist"] == pytest.approx(m)


@pytest.mark.parametrize("hot", [100_000, 3])
def test_means_over_loci(spark, hot):
    rows = random_calls(40, 6, seed=8, share=0.5) + [(200 + i, 77, i, k, f"s{k}", 0, i % 2, i % 2, 1) for i in range(9) for k in (0, 5)]
    calls = spark.createDataFrame(rows, CALLS).repartition(3)
    names = [f"s{i}" for i in range(6)]
    for method in ("genpofad", "matchstates", "euclidean"):
        means = defaultdict(list)
        for locus in {r[1] for r in rows}:
            own = [r for r in rows if r[1] == locus and r[7] is not None]
            g = {(r[0], r[3]): (r[5], r[6]) for r in own}
            sites = {r[0] for r in own}
            for i in range(6):
                for j in range(i + 1, 6):
                    both = [(set(g[s, i]), set(g[s, j]), sum(g[s, i]) - sum(g[s, j])) for s in sites if (s, i) in g and (s, j) in g]
                    if both:
                        d = {"genpofad": lambda a, b: 1 - len(a & b) / max(len(a), len(b)), "matchstates": lambda a, b: 1 - (len(a & b) / len(a) + len(a & b) / len(b)) / 2}.get(method)
                        means[i, j].append(np.mean([d(a, b) for a, b, _ in both]) if d else np.sqrt(sum(x * x for *_, x in both) * len(sites) / len(both)))
        got = {(int(r["a"][1:]), int(r["b"][1:])): (r["dist"], r["loci"]) for r in PA.locus_averaged(calls, method, names, hot).collect()}
        assert got == {k: (pytest.approx(np.mean(v)), len(v)) for k, v in means.items()}, method


def greedy(tags):
    kept = []
    for locus, seq, rep in sorted(tags, key=lambda t: (-t[2], t[0])):
        if all(sum(x != y for x, y in zip(seq[5:], k[5:])) > 9 for _, k in kept):
            kept.append((locus, seq))
    return {locus for locus, _ in kept}


def test_hamming_in_order(spark, monkeypatch):
    monkeypatch.setattr(FI, "HOT_TAGS", 6)
    rng = random.Random(5)
    turn = lambda t, places: "".join("ACGT"[("ACGT".index(c) + 1) % 4] if i in places else c for i, c in enumerate(t))
    base = "".join(rng.choice("ACGT") for _ in range(69))
    chain = [base]
    for step in range(7):  # each is near the next one only
        chain.append(turn(chain[-1], range(5 + 8 * step, 13 + 8 * step)))
    tags = [*chain, *("".join(rng.choice("ACGT") for _ in range(69)) for _ in range(30))]
    shared = "ACGTACG"  # all tags of a group share their first segment
    tags += [base[:5] + shared + "".join(rng.choice("ACGT") for _ in range(57)) for _ in range(20)]
    tags += [turn(tags[-1], rng.sample(range(5, 69), 8)) for _ in range(4)] + [tags[3]] * 3 + [turn(tags[3], [0, 1])]
    rows = [(i, t, float(rng.choice([0.5, 0.75, 1.0]))) for i, t in enumerate(tags)]
    got = {r["locus"] for r in FI.filter_hamming(spark.createDataFrame(rows, "locus long, seq string, rep_avg double").repartition(3)).collect()}
    assert got == greedy(rows)
    plain = [(i, t, 0.0) for i, t, _ in rows]
    got = {r["locus"] for r in FI.filter_hamming(spark.createDataFrame([r[:2] for r in rows], "locus long, seq string")).collect()}
    assert got == greedy(plain)
    assert FI.filter_hamming(spark.createDataFrame([], "locus long, seq string")).count() == 0


def test_smallest_of_longs(spark, monkeypatch):
    monkeypatch.setattr(SE, "RANGES", 5)
    rng = random.Random(4)
    rows = [(rng.choice([-(2**63), 2**63 - 1, 0, rng.randrange(-(2**63), 2**63), rng.randrange(20)]), i // 2) for i in range(300)] + [(None, 1)]
    df = spark.createDataFrame(rows, "x long, site_id long").repartition(3)
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    for n in (0, 1, 7, 150, 299, 300, 301, 999):
        got = sorted((tuple(r) for r in SE.smallest(df, n, F.col("x"), F.col("site_id")).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        assert got == order[:n], n


def test_quantiles_by_ranges(spark, monkeypatch):
    monkeypatch.setattr(SE, "RANGES", 64)
    monkeypatch.setattr(SE, "FEW", 5)
    rng = random.Random(6)
    rows = [("a", rng.gauss(0, 1)) for _ in range(400)] + [("b", 1.5)] * 50 + [("c", rng.choice([1e-300, 0.0, 1e300, 3.0])) for _ in range(60)] + [("d", None), ("e", 7.0), (None, 1.0), (None, 2.0), ("f", float("nan"))]
    df = spark.createDataFrame(rows, "g string, x double").repartition(3)
    shares = (0.0, 0.25, 0.5, 0.9, 1.0)
    got = {r["g"]: r["q"] for r in SE.quantiles(df, "x", ["g"], shares).collect()}
    want = {g: list(np.quantile([x for h, x in rows if h == g], shares)) for g in ("a", "b", "c", "e", None)}
    assert got.keys() == want.keys()
    for g in want:
        assert got[g] == pytest.approx(want[g], rel=1e-12), g
    s = {r["g"]: r for r in S.summary(df, "x", "g").collect()}
    assert s["d"]["median"] is None and s["b"]["q3"] == 1.5 and s[None]["median"] == 1.5


def test_mantel_by_matrices_and_by_joins(spark, monkeypatch):
    rng = random.Random(7)
    names = [f"n{i:02d}" for i in range(9)]
    pairs = [(a, b, rng.random()) for a in names for b in names if a < b and rng.random() < 0.9]
    other = [(b, a, x + rng.random()) for a, b, x in pairs if rng.random() < 0.95] + [("n00", "n00", 5.0)]
    x, y = (spark.createDataFrame(p, "a string, b string, dist double") for p in (pairs, other))
    one = I.mantel(x, y, 60).first()
    monkeypatch.setattr(I, "MANTEL_NAMES", 0)
    two = I.mantel(x, y, 60).first()
    assert one["r"] == pytest.approx(two["r"]) and one["p"] == two["p"] and one["n"] == two["n"] == 9
    assert I.mantel(x.where("false"), y, 5).first()["r"] is None


def test_mantel_of_two_thousand_names(spark):
    """The tasks' part alone: a permutation of 2000 names costs a gather, and no rows."""
    p = I.permuted(1, 3, 2000)
    assert sorted(p.tolist()) == list(range(2000)) and (I.permuted(1, 3, 2000) == p).all() and (I.permuted(1, 4, 2000) != p).any()


@pytest.mark.parametrize("columns", [64, 5])
def test_axes_equal_eigenvectors(spark, columns):
    rng = np.random.default_rng(2)
    n, sites = 40, 300
    group = np.arange(n) % 4
    freq = rng.random((sites, 4))
    g = rng.binomial(2, freq[:, group])
    rows = [(s, s, 0, i, f"s{i}", int(g[s, i] > 0) if g[s, i] < 2 else 1, int(g[s, i] > 1), int(g[s, i]), 1) for s in range(sites) for i in range(n) if rng.random() < 0.9]
    x = np.full((sites, n), np.nan)
    for r in rows:
        x[r[0], r[3]] = r[7]
    x = np.nan_to_num(x - np.nanmean(x, axis=1, keepdims=True))
    values, vectors = np.linalg.eigh(x.T @ x / n)
    planes = PL.from_calls(spark.createDataFrame(rows, CALLS).repartition(3), n)
    got = O.pca(planes, [f"s{i}" for i in range(n)], 3, columns=columns).toPandas()
    for a in range(3):
        score = got[got.axis == a + 1].set_index("sample").score[[f"s{i}" for i in range(n)]].to_numpy()
        want = vectors[:, -1 - a] * np.sqrt(values[-1 - a] * n)
        assert min(np.abs(score - want).max(), np.abs(score + want).max()) < 1e-6
        assert got[got.axis == a + 1].percent.iat[0] == round(100 * values[-1 - a] / values.sum(), 1)
    assert O.pca(PL.from_calls(spark.createDataFrame([], CALLS), 3), list("abc"), 2).toPandas().score.abs().sum() == 0


def test_alignments_across_batches(spark):
    rng = random.Random(8)
    seqs = [(locus, f"s{i}", "".join(rng.choice("ACGTRYKMN?-acgt*") for _ in range(5 if locus % 3 else 5 - i % 2))) for locus in range(12) for i in range(7) if rng.random() < 0.8]
    seqs += [(50, "s0", ""), (51, "s0", "???"), (3, "s0", "ACGTA"), (None, "s1", "AC"), (4, "s1", None)]
    df = spark.createDataFrame(seqs, "locus long, sample string, seq string").repartition(3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    results = []
    for size in ("10000", "3"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        results.append([sorted(map(tuple, f(df, 7).collect()), key=str) for f in (L.site_diversity, L.alignment_diversity)])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert str(results[0]) == str(results[1])
    bases = {"a": "aa", "c": "cc", "g": "gg", "t": "tt", "r": "ag", "y": "ct", "k": "gt", "m": "ac"}
    got = {(r["locus"], r["pos"]): r for r in L.site_diversity(df, 7).collect()}
    for locus in range(12):
        for pos in range(5):
            cs = [s[pos].lower() for lo, _, s in seqs if lo == locus and s is not None and len(s) > pos and s[pos].lower() not in "?n-"]
            if not cs:
                assert (locus, pos) not in got
                continue
            r, b = got[locus, pos], "".join(bases.get(c, "") for c in cs)
            assert (r["present"], r["genotypes"]) == (len(cs), len(set(cs))) and r["ho"] == pytest.approx(sum(c in "rykm" for c in cs) / len(cs))
            t = len(b)
            want = (1 - sum(b.count(x) * (b.count(x) - 1) for x in "acgt") / (t * (t - 1))) * 2 * len(cs) / (2 * len(cs) - 1) if t > 1 else None
            assert r["pi"] == (None if want is None else pytest.approx(want))
    rows = {r["locus"]: r for r in L.alignment_diversity(df, 7).collect()}
    assert rows[51]["missing_percent"] == 100 and rows[51]["ho"] is None and rows[50]["sites"] == 0 and rows[3]["samples"] == len({s for lo, s, _ in seqs if lo == 3})


def _missing_by_hand(rows, n, sites, limit):
    have = [len({r[0] for r in rows if r[3] == i and r[0] in sites and (r[5] is not None or r[6] is not None)}) for i in range(n)]
    return [i for i in range(n) if sites and 1 - have[i] / len(sites) < limit]


@pytest.mark.parametrize("n", [6, 70])
def test_samples_are_dropped_alike_from_planes_and_arrays(spark, n):
    rows = [r for r in random_calls(40, n, seed=n + 1, share=0.8) if r[3] % 3 or r[0] % 2]
    names, calls = [f"s{i}" for i in range(n)], spark.createDataFrame(rows, CALLS)
    keep = _missing_by_hand(rows, n, {r[0] for r in rows}, 0.4)
    assert 0 < len(keep) < n
    packed, kept = FI.drop_samples_by_missing(P.to_packed(calls, n), names, 0.4)
    planes, kept2 = FI.drop_samples_by_missing(PL.from_calls(calls, n), names, 0.4)
    assert kept == kept2 == [names[i] for i in keep]
    want = {s: sum(r[0] == s and r[3] in keep for r in rows) for s in {r[0] for r in rows}}
    for got in (packed.select("site_id", P.n_called().alias("n")), planes.sites.select("site_id", planes.n_called().alias("n"))):
        assert {r["site_id"]: r["n"] for r in got.collect()} == want
    assert FI.drop_samples_by_missing(PL.from_calls(calls.where("false"), n), names, 0.4)[1] == []


@pytest.mark.parametrize("depth", [True, False])
def test_strict_filter_of_calls_equals_that_of_arrays(spark, depth):
    n = 7
    rows = [r for r in random_calls(80, n, seed=9, share=0.9) if r[3] or r[0] % 3]
    names, calls = [f"s{i}" for i in range(n)], spark.createDataFrame(rows, CALLS)
    rules = (depth, 0.3, 0.6 if depth else 0.3, (3, 80), 12, 2)
    packed, kept = FI.strict_filter(P.to_packed(calls, n), names, *rules)
    p, kept2 = FI.strict_filter_calls(calls, names, *rules)
    assert kept == kept2 and 0 < len(kept) < n
    got = {r["site_id"]: r["n"] for r in p.sites.select("site_id", p.n_called().alias("n")).collect()}
    assert got == {r["site_id"]: r["n"] for r in packed.select("site_id", P.n_called().alias("n")).collect()} and 0 < len(got) <= 80


def test_columns_are_kept_in_any_order_and_once_made(spark):
    n = 70  # the calls were made anew for each place kept, and their map for each call
    rows = random_calls(30, n, seed=2)
    packed = P.to_packed(spark.createDataFrame(rows, CALLS), n)
    full = {r["site_id"]: r["calls"] for r in packed.collect()}
    for idx in (list(range(0, n, 2)), [5, 1, 9], [3, 3], []):
        assert {r["site_id"]: r["calls"] for r in P.keep_columns(packed, idx).collect()} == {s: [c[i] for i in idx] for s, c in full.items()}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
@pytest.mark.parametrize("name", ["drop_samples_by_missing", "strict_filter"])
def test_sample_filters_do_not_pack_arrays(spark, monkeypatch, name):
    made = []
    monkeypatch.setattr(P, "by_place", lambda *a: made.append(a) or pytest.fail("arrays of calls"))
    assert Q.QUERIES[name](spark, "/root/testdata/sf0.001").count() >= 0 and not made
