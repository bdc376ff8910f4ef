"""Expressions against hand-computed answers."""

import math

import pytest
from pyspark.sql import functions as F

from locusframe.functions import genotype as G
from locusframe.functions import measures as M


@pytest.fixture
def one(spark):
    row = spark.range(1)
    return lambda c: row.select(c.alias("x")).first()["x"]


def test_parse_gt(one):
    assert one(G.parse_gt(F.lit("0|1:20:0,1"))) == [0, 1]
    assert one(G.parse_gt(F.lit("./.:0"))) == [None, None]
    assert one(G.parse_gt(F.lit("./1"))) == [None, 1]


def test_called_rules(one):
    half = F.array(F.lit(None).cast("int"), F.lit(1))
    assert one(G.is_called(half)) is True
    assert one(G.is_called(half, "all")) is False
    assert one(G.dosage(half)) is None
    assert one(G.dosage(F.array(F.lit(1), F.lit(1)))) == 2


def test_fields(one):
    fmt = F.split(F.lit("GT:CATG:DP"), ":")
    assert one(G.format_field(F.lit("0/1:a:17"), fmt, "DP")) == "17"
    assert one(G.format_field(F.lit("0/1:a:17"), fmt, "PL")) is None
    assert one(G.info_number(F.str_to_map(F.lit("AN=8;DP=2"), F.lit(";"), F.lit("=")))) == 8
    assert one(G.info_number(F.str_to_map(F.lit("NS=3;AN=8"), F.lit(";"), F.lit("=")))) == 3


def test_bases_and_codes(one):
    alleles = F.array(F.lit("A"), F.lit("T"), F.lit("*"))
    assert one(G.to_bases(F.array(F.lit(0), F.lit(2)), alleles)) == ["A", "?"]
    assert one(G.iupac(F.array(F.lit("T"), F.lit("A")))) == "W"
    assert one(G.iupac(F.array(F.lit("?"), F.lit("A")))) == "A"
    assert one(G.iupac(F.array(F.lit("?"), F.lit("?")))) == "?"
    assert one(G.iupac_expand(F.lit("w"))) == ["a", "t"]
    assert one(G.iupac_expand(F.lit("c"))) == ["c", "c"]
    assert one(G.genotype_key(F.array(F.lit(1), F.lit(0)))) == "01"
    assert one(G.locus_of(F.lit("loc7_12"))) == "loc7"
    assert one(G.replicate_base(F.lit("s1_R2"))) == "s1"


def test_likelihood(one):
    got = one(G.pl_to_likelihood(F.array(F.lit(0.0), F.lit(10.0), F.lit(20.0))))
    assert got == pytest.approx([1 / 1.11, 0.1 / 1.11, 0.01 / 1.11])
    assert one(G.pl_to_likelihood(F.lit(None).cast("array<double>"))) == pytest.approx([1 / 3] * 3)


def test_distances(spark, one):
    assert one(M.great_circle_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0))) == pytest.approx(math.pi * 6378.137 / 2)
    places = spark.createDataFrame([(-37.95103341666667, 144.42486788888888, -37.65282113888889, 143.92649552777777)], "a double, b double, c double, d double")
    got = places.select(M.geodesic_km("a", "b", "c", "d").alias("x")).first()["x"]
    assert got == pytest.approx(54.972271, abs=1e-4)  # the published example of the formula


def test_transforms(one):
    assert one(M.linearised_fst(F.lit(0.5))) == 1.0
    assert one(M.linearised_fst(F.lit(-0.5), True)) == 0.0
    assert one(M.log_km(F.lit(0.0), F.lit(True))) == 0.0


def test_trees(one):
    assert one(M.mean_tree_support(F.lit("((a:1,b:1)90:1,(c:1,d:1)70:1,(e,f):2);"))) == 80
    assert one(M.mean_tree_support(F.lit("(a,b);"))) is None
    text = '[&sCF/sDF1/sDF2="43.4/42.8/13.8"] [&sCF/sDF1/sDF2="0/0/0"]'
    assert one(M.concordance_factors(F.lit(text))) == [[43.4, 42.8, 13.8], None]
    assert one(M.yule_lambda(F.lit(0.1), F.lit(3))) == 8.3  # (1/6 + 2/3) / 0.1
