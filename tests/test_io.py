"""Readers and writers on small hand-written files."""

import pytest
from pyspark.sql import functions as F

from locusframe.functions import genotype as G
from locusframe.operators import packed as P
from locusframe.operators import stats as S
from locusframe.sources import sequences as SQ
from locusframe.sources import tables as T
from locusframe.sources import vcf as V

VCF = """##fileformat=VCFv4.0
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\ts3
RAD_1\t5\tloc1_pos5\tA\tT\t13\tPASS\tNS=2;DP=40\tGT:DP:CATG\t0/1:20:0,10,10,0\t./.:0:0,0,0,0\t1|1:20:0,0,20,0
RAD_1\t9\tloc1_pos9\tC\tT,G\t13\tPASS\tNS=3;DP=40\tGT:DP:CATG\t1/2:20:0,10,10,0\t0/0:7:0,0,0,0\t./1:20:0,0,20,0
RAD_2\t1\tloc2_pos1\tG\t*\t13\tPASS\tAN=4\tGT:CATG:DP\t0/1:0:3\t0/0:0:.\t./.:0:0
"""


@pytest.fixture
def vcf(tmp_path):
    path = tmp_path / "x.vcf"
    path.write_text(VCF)
    return str(path)


def test_read_vcf(spark, vcf):
    sites, names = V.read_vcf(spark, vcf)
    assert names == ["s1", "s2", "s3"]
    rows = {r["snp_id"]: r for r in sites.collect()}
    assert rows["loc1_pos5"]["calls"][2]["gt"] == [1, 1] and rows["loc1_pos5"]["calls"][2]["phased"]
    assert rows["loc1_pos9"]["alleles"] == ["C", "T", "G"]
    assert rows["loc2_pos1"]["calls"][0]["dp"] == 3 and rows["loc2_pos1"]["calls"][1]["dp"] is None
    stats = {r["snp_id"]: r for r in sites.select("snp_id", P.n_called().alias("n"), P.max_depth(10).alias("lo"), P.min_depth(1).alias("hi")).collect()}
    assert [stats[k]["n"] for k in ("loc1_pos5", "loc1_pos9", "loc2_pos1")] == [2, 3, 2]
    assert stats["loc2_pos1"]["lo"] and not stats["loc1_pos5"]["lo"]


def test_ns_and_single_snp(spark, vcf):
    sites, _ = V.read_vcf(spark, vcf)
    best = S.one_snp_per_locus(V.require_ns(sites).withColumn("site_id", F.col("pos")), F.col("ns"))
    assert {r["snp_id"] for r in best.collect()} == {"loc1_pos9", "loc2_pos1"}


def test_missing_ns_is_an_error(spark, tmp_path):
    path = tmp_path / "y.vcf"
    path.write_text(VCF.replace("NS=2;", "").replace("DP=40\tGT", "DP=4\tGT", 1))
    with pytest.raises(Exception, match="neither NS nor AN"):
        V.require_ns(V.read_vcf(spark, str(path))[0]).select("ns").collect()


def test_write_vcf_round_trip(spark, vcf, tmp_path):
    sites, names = V.read_vcf(spark, vcf)
    out = str(tmp_path / "out")
    V.write_vcf(sites.withColumn("i", F.monotonically_increasing_id()), names, out, "i")
    again, names2 = V.read_vcf(spark, out)
    pick = lambda df: sorted((r["snp_id"], str([c["gt"] for c in r["calls"]])) for r in df.collect())
    assert names2 == names and pick(again) == pick(sites)
    rows = [r for r in VCF.splitlines() if not r.startswith("#")]
    for df in (sites, again):  # every field as it was, numbered in file order
        assert [(r["site_id"], r["value"]) for r in V.to_lines(df, "site_id").collect()] == list(enumerate(rows))
    parts = sorted((tmp_path / "out").glob("part-*"))
    assert "".join(p.read_text() for p in parts).splitlines()[:2] == ["##fileformat=VCFv4.2", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\ts3"]
    masked = V.to_lines(P.mask_calls_by_depth(sites, 10, 100), "site_id")
    assert masked.collect()[1]["value"].endswith("1/2:20:0,10,10,0\t./.:7:0,0,0,0\t./1:20:0,0,20,0")


def test_add_pl(spark, vcf):
    sites = V.add_pl(V.read_vcf(spark, vcf)[0])
    line = V.to_lines(sites).where("value like 'RAD_1\t5%'").first()["value"]
    assert "GT:DP:CATG:PL" in line and line.endswith("1|1:20:0,0,20,0:0.0,0.0,0.0")


def test_lists_and_unmatched(spark, tmp_path):
    (tmp_path / "ids").write_text("a \n\nb\n")
    assert [r["id"] for r in V.read_id_list(spark, str(tmp_path / "ids")).collect()] == ["a", "b"]
    (tmp_path / "pops").write_text("s1\t1\ns2\t2\n")
    table = V.read_samples(spark, str(tmp_path / "pops"))
    assert [r["pop"] for r in table.collect()] == ["1", "2"]
    names = spark.createDataFrame([("s1",), ("s9",)], "sample string")
    assert {tuple(r) for r in V.unmatched(names, table).collect()} == {("s9", "table"), ("s2", "data")}
    with pytest.raises(ValueError, match="s9"):
        V.require_samples(names, table)


def test_loci_and_fasta(spark, tmp_path):
    (tmp_path / "a.loci").write_text("s1  ACGT\ns2  AC-T\n//    *   |0|\ns1  GG\n//      |7|\n")
    rows = SQ.read_loci(spark, str(tmp_path / "a.loci")).orderBy("locus", "ord").collect()
    assert [(r["locus"], r["sample"], r["seq"]) for r in rows] == [("0", "s1", "ACGT"), ("0", "s2", "AC-T"), ("7", "s1", "GG")]
    (tmp_path / "b.fa").write_text("# note\n>CLocus_1_Sample_100_Locus_1_Allele_0 [sA]\nACGT\n>CLocus_1_Sample_100_Locus_1_Allele_1 [sA]\nACGA\n")
    rows = SQ.read_stacks_fasta(spark, str(tmp_path / "b.fa")).orderBy("allele").collect()
    assert [tuple(r) for r in rows] == [("1", "sA", 0, "ACGT"), ("1", "sA", 1, "ACGA")]
    (tmp_path / "aln").mkdir()
    (tmp_path / "aln" / "L5.fasta").write_text(">x\nAC\nGT\n>y\nNN?-\n")
    rows = SQ.read_alignments(spark, str(tmp_path / "aln" / "*.fasta")).orderBy("sample").collect()
    assert [tuple(r) for r in rows] == [("L5", "x", "acgt"), ("L5", "y", "nn?-")]
    SQ.write_fasta(spark.createDataFrame([("1", "x", "AC")], "locus string, sample string, seq string"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).select("value").collect()


def test_nexus_and_matrix(spark, tmp_path):
    (tmp_path / "n").write_text("#NEXUS\nMATRIX\ns1\t012?\ns2\t0000\n;\n")
    rows = SQ.read_nexus012(spark, str(tmp_path / "n")).orderBy("sample").collect()
    assert rows[0]["dosages"] == [0, 1, 2, None]
    (tmp_path / "m").write_text("a b c\na 0 NA NA\nb 0.1 0 NA\nc 0.2 0.3 0\n")
    got = {(r["a"], r["b"]): r["dist"] for r in T.read_matrix(spark, str(tmp_path / "m")).collect()}
    assert len(got) == 6 and got["a", "b"] == 0.1 and got["c", "b"] == got["b", "c"] == 0.3
    pairs = spark.createDataFrame([("a", "b", 0.25), ("a", "c", 0.5)], "a string, b string, dist double")
    T.write_pairs(pairs, str(tmp_path / "p"))
    assert sorted(tuple(r) for r in T.read_pairs(spark, str(tmp_path / "p")).collect()) == [("a", "b", 0.25), ("a", "c", 0.5)]


def test_dart(spark, tmp_path):
    (tmp_path / "d.csv").write_text("AlleleID,SNP,i1,i2,i3\n7|F|0,,1,0,1\n7|F|0--1:A>T,1:A>T,0,1,1\n8|F|0,,1,1,-\n8|F|0--1:A>T,1:A>T,0,0,-\n")
    (tmp_path / "m.csv").write_text("id,pop,lat,lon\ni1,p,1,2\ni2,p,1,2\ni3,q,1,2\n")
    rows = T.read_dart(spark, str(tmp_path / "d.csv"), str(tmp_path / "m.csv")).orderBy("sample").collect()
    assert [(r["snp"], r["sample"], r["dosage"]) for r in rows] == [("7", "i1", 0), ("7", "i2", 2), ("7", "i3", 1)]


def test_vcftools_and_stats(spark, tmp_path):
    w = lambda n, t: (tmp_path / n).write_text(t)
    w("x.idepth", "INDV\tN_SITES\tMEAN_DEPTH\na\t3\t9.5\n")
    w("x.imiss", "INDV\tN_DATA\tF_MISS\na\t3\t0.25\n")
    w("x.het", "INDV\tO(HOM)\tF\na\t3\t0.1\n")
    w("x.ldepth.mean", "CHROM\tPOS\tMEAN_DEPTH\tVAR_DEPTH\nc\t5\t8\t1\n")
    w("x.lmiss", "CHR\tPOS\tF_MISS\nc\t5\t0.5\n")
    indv, sites = T.read_vcftools_tables(spark, str(tmp_path / "x"))
    assert tuple(indv.first()) == ("a", 9.5, 0.25, 0.1) and tuple(sites.first()) == ("c", 5, 8.0, 0.5)
    (tmp_path / "clust_90").mkdir()
    w("clust_90/run_stats.txt", "## The number of loci caught by each filter.\n   total_filters  applied_order  retained_loci\nfiltered_by_max_shared_het   5  3  88\ntotal_filtered_loci  1  0  120\n"
      "\n## Alignment matrix statistics:\nsnps matrix size: (12, 345), 3.10% missing sites.\nno numbers: here\n")
    w("clust_90/s5_stats.txt", "    state  clusters_total  filtered_by_maxAlleles  heterozygosity\ns1   5   200   50   0.5\ns2   5   0   0   nan\nbroken row\n")
    stats = T.read_stats(spark, [str(tmp_path / "clust_90" / n) for n in ("run_stats.txt", "s5_stats.txt")])
    assert tuple(T.assembly_summary(stats).first()) == ("90", 3.0, 88.0, 3 / 88, 120.0, 345.0)
    got = {r["sample"]: r for r in T.assembly_by_sample(stats, spark.createDataFrame([("s1",), ("s2",), ("s3",)], "sample string")).collect()}
    assert got["s1"]["paralogs"] == 0.25 and got["s1"]["heterozygosity"] == 0.5 and got["s2"]["paralogs"] is None and set(got) == {"s1", "s2"}
    assert {r["section"] for r in stats.where("name = 'snps matrix size'").collect()} == {"Alignment matrix statistics:"}


def test_rows_are_made_once_when_written(spark, monkeypatch, vcf, tmp_path):
    """Sorting reads its input twice, so the rows stand in a table before; it is removed."""
    sites, names = V.read_vcf(spark, vcf)
    made = spark.sparkContext.accumulator(0)

    def seen(x):
        made.add(1)
        return x

    monkeypatch.setattr(V, "shared_path", lambda _: f"file://{tmp_path}/shared")
    V.write_vcf(sites.withColumn("qual", F.udf(seen, "string")("qual")), names, str(tmp_path / "out"))
    assert made.value == 3 and not (tmp_path / "shared").exists()
    rows = [r for r in VCF.splitlines() if not r.startswith("#")]
    got = V.to_lines(V.read_vcf(spark, str(tmp_path / "out"))[0], "site_id", sort=False)
    assert sorted((r["site_id"], r["value"]) for r in got.collect()) == list(enumerate(rows))


def test_usual_and_other_genotypes(spark):
    texts = ["0/1", "1|0:5", "./.", ".|1", "2/1", "0", ".", "10|11:3", "0/1/1", "", "x/1"]
    want = [[0, 1], [1, 0], [None, None], [None, 1], [2, 1], [0], [None], [10, 11], [0, 1, 1], [None], [None, 1]]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r["g"] for r in df.select(G.parse_gt(F.col("t")).alias("g")).collect()] == want
    row = "c\t1\ts\tA\tT\t13\tPASS\tNS=1\tGT:DP:PL\t0/1:.:0,3,.\t1/1:x:.\t./.\t0|0:7"
    calls = V.parse_lines(spark.createDataFrame([(row,)], "value string")).first()["calls"]
    assert [(c["gt"], c["phased"], c["dp"], c["pl"]) for c in calls] == [([0, 1], False, None, [0, 3, None]), ([1, 1], False, None, [None]), ([None, None], False, None, None), ([0, 0], True, 7, None)]


def test_fasta_of_many_loci_together(spark, tmp_path):
    """As many files as tasks, not as loci; a locus is whole in one of them; the same rows as from a folder per locus."""
    rows = [(n, s, q) for n in range(60) for s, q in (("x y", "AC"), ("z[1]", "N?"))] + [(None, "x y", "GG")]
    seqs = spark.createDataFrame(rows, "locus long, sample string, seq string")
    SQ.write_fasta(seqs, str(tmp_path / "one"), together=True)
    SQ.write_fasta(seqs, str(tmp_path / "many"))
    files = sorted((tmp_path / "one").glob("part-*"))
    assert len(files) <= 3 and files[0].read_text().startswith(">") and len(list((tmp_path / "many").glob("locus=*"))) == 61
    assert all(sum(f"[locus={n}]" in f.read_text() for f in files) == 1 for n in range(60))
    read = lambda name: sorted(tuple(r) for r in SQ.read_alignments(spark, str(tmp_path / name)).collect())
    assert read("one") == read("many") == sorted(("__HIVE_DEFAULT_PARTITION__" if n is None else str(n), s, q.lower()) for n, s, q in rows)
