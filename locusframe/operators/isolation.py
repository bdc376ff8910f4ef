"""Isolation by distance: geography of pairs, regression, and the Mantel test."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window as W

from ..functions import measures as M
from ..sources.shared import written
from ..sources.sides import small_side


def with_km(pairs: DataFrame, places: DataFrame, ellipsoid: bool = False) -> DataFrame:
    """Pairs with the distance of their places (id, lat, lon); pairs without places are left out."""
    p = pairs
    for s in "ab":
        p = p.join(small_side(places.select(F.col("id").alias(s), F.col("lat").alias(f"lat_{s}"), F.col("lon").alias(f"lon_{s}"))), s)
    km = (M.geodesic_km if ellipsoid else M.great_circle_km)(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"))
    return p.withColumn("km", km).drop("lat_a", "lon_a", "lat_b", "lon_b")


def distance_geo_corr(pairs: DataFrame, *by: str) -> DataFrame:
    """Pearson's r of dist with km, and the slope as percent per 100 km."""
    return pairs.groupBy(*by).agg(F.corr("dist", "km").alias("r"), (F.regr_slope("dist", "km") * 1e4).alias("slope_per_100km"))


def linearised(pairs: DataFrame, clip: bool = False) -> DataFrame:
    """Pairs with F / (1 - F) and the logarithm of km."""
    zero = pairs.agg(F.coalesce(F.bool_or(F.col("km") == 0), F.lit(False)).alias("any_zero"))
    return pairs.crossJoin(F.broadcast(zero)).withColumn("dist", M.linearised_fst(F.col("dist"), clip)).withColumn("km", M.log_km(F.col("km"), F.col("any_zero"))).drop("any_zero")


def _beta(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d, tiny = 1.0, 1 - (a + b) * x / (a + 1), 1e-300
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 300):
        for t in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + t * d, 1 + t / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * out


@F.pandas_udf(DoubleType())
def slope_p(r2: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p of a regression's slope from R squared and the number of points."""
    return pd.Series([None if pd.isna(x) or m < 3 else 0.0 if x >= 1 else _beta(1 / (1 + x * (m - 2) / (1 - x) / (m - 2)), (m - 2) / 2, 0.5) for x, m in zip(r2, n)], dtype="float64")


def ibd_regression(pairs: DataFrame) -> DataFrame:
    """One row: slope, intercept, R squared, adjusted R squared, number of pairs."""
    got = pairs.agg(F.regr_slope("dist", "km").alias("slope"), F.regr_intercept("dist", "km").alias("intercept"), F.regr_r2("dist", "km").alias("r2"), F.regr_count("dist", "km").alias("n"))
    return got.withColumn("adj_r2", 1 - (1 - F.col("r2")) * (F.col("n") - 1) / (F.col("n") - 2))


def ibd_regression_p(pairs: DataFrame) -> DataFrame:
    """`ibd_regression` with the p of the slope."""
    return ibd_regression(pairs).withColumn("p", slope_p("r2", "n"))


#: Names up to which the two matrices travel to the tasks (8 bytes a pair and matrix: 256 MB together); beyond, pairs are joined.
MANTEL_NAMES = 4096


def permuted(seed: int, trial: int, n: int) -> np.ndarray:
    """A permutation of n places: their order by the MD5 of seed, trial and place as text, which SQL can repeat."""
    return np.array(sorted(range(n), key=lambda i: hashlib.md5(f"{seed}:{trial}:{i}".encode()).hexdigest()), np.int64)


def mantel(x: DataFrame, y: DataFrame, permutations: int = 999, seed: int = 1) -> DataFrame:
    """One row: r, p = (number of permuted r >= r, + 1) / (permutations + 1), and n, the number of names.

    Tables of pairs (a, b, dist) of populations or samples, joined; missing pairs are left out, repeated
    ones count by their mean. Names are numbered in their order; permutation t puts name i in the place of the
    i-th name in the order of MD5(seed:t:i) (`permuted`), and the pairs of y are renamed by it.

    Both matrices are gathered once, for names up to MANTEL_NAMES, and broadcast; tasks take permutation
    numbers, gather y by the permuted places and return one correlation each, so there is no row for a
    permutation and pair. With more names, permutations and pairs are joined by shuffles. No pair: r is null.
    """
    spark = x.sparkSession
    pair = lambda df, c: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("dist").alias(c)).where(f"{c} is not null and a != b").groupBy("a", "b").agg(F.avg(c).alias(c))
    both = written(pair(x, "x").join(pair(y, "y"), ["a", "b"]))
    names = both.select(F.explode(F.array("a", "b")).alias("name")).distinct()
    n = names.count()
    numbered = names.select("name", (F.row_number().over(W.orderBy("name")) - 1).alias("i"))  # names, not pairs
    place = lambda c, out: numbered.select(F.col("name").alias(c), F.col("i").alias(out))
    at = both.join(place("a", "p"), "a").join(place("b", "q"), "b").select("p", "q", "x", "y")
    real = at.agg(F.corr("x", "y").alias("real"))
    trials = spark.range(permutations, numPartitions=max(1, min(permutations, spark.sparkContext.defaultParallelism))).select(F.col("id").alias("t"))
    if n <= MANTEL_NAMES:
        pairs = at.toPandas()  # n * n / 2 of them at most
        given, wanted = np.full((n, n), np.nan), np.full((n, n), np.nan)
        for m, c in ((given, "x"), (wanted, "y")):
            m[pairs.p, pairs.q] = m[pairs.q, pairs.p] = pairs[c]
        shared = spark.sparkContext.broadcast((given, wanted))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            xs, ys = shared.value
            upper = np.arange(n)[:, None] < np.arange(n)[None, :]
            for pdf in batches:
                out = []
                for t in pdf.t.tolist():
                    back = np.empty(n, np.int64)
                    back[permuted(seed, t, n)] = np.arange(n)
                    moved = ys[np.ix_(back, back)]
                    ok = upper & ~np.isnan(xs) & ~np.isnan(moved)
                    u, v = xs[ok], moved[ok]
                    u, v = u - u.mean() if len(u) else u, v - v.mean() if len(v) else v
                    below = math.sqrt(float(u @ u) * float(v @ v))
                    out.append(float(u @ v) / below if below > 0 else None)
                yield pd.DataFrame({"r": pd.Series(out, dtype="float64")})

        per = trials.mapInPandas(run, "r double")
    else:
        drawn = trials.crossJoin(numbered.select("i")).withColumn("to", F.row_number().over(W.partitionBy("t").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("t").cast("string"), F.col("i").cast("string"))))) - 1)
        image = drawn.select("t", F.col("to").alias("old"), F.col("i").alias("new"))
        moved = at.select("p", "q", "y").join(image.select("t", F.col("old").alias("p"), F.col("new").alias("u")), "p").join(image.select("t", F.col("old").alias("q"), F.col("new").alias("v")), ["t", "q"])
        met = moved.select("t", F.least("u", "v").alias("p"), F.greatest("u", "v").alias("q"), "y").join(at.select(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"), "x"), ["p", "q"])
        per = met.groupBy("t").agg(F.corr("x", "y").alias("r"))
    hits = per.crossJoin(F.broadcast(real)).agg(F.count(F.when(F.col("r") >= F.col("real") - 1e-12, 1)).alias("h"))
    return real.crossJoin(hits).select(F.col("real").alias("r"), ((F.col("h") + 1) / F.lit(permutations + 1)).alias("p"), F.lit(n).cast("long").alias("n"))
