"""Column expressions for geography, Fst transforms, trees and node ages."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

EARTH_KM = 6378.137


def great_circle_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Haversine distance on a sphere of the equatorial radius."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


@F.pandas_udf(DoubleType())
def geodesic_km(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.Series:
    """Distance on the WGS84 ellipsoid by Vincenty's iteration; null inputs give null."""
    a, f = 6378.137, 1 / 298.257223563
    b = a * (1 - f)
    p1, p2 = (np.arctan((1 - f) * np.tan(np.radians(x.to_numpy(float)))) for x in (lat1, lat2))
    diff = np.radians(lon2.to_numpy(float) - lon1.to_numpy(float))
    lam = diff.copy()
    with np.errstate(divide="ignore", invalid="ignore"):
        for _ in range(200):
            s = np.hypot(np.cos(p2) * np.sin(lam), np.cos(p1) * np.sin(p2) - np.sin(p1) * np.cos(p2) * np.cos(lam))
            c = np.sin(p1) * np.sin(p2) + np.cos(p1) * np.cos(p2) * np.cos(lam)
            sigma = np.arctan2(s, c)
            alpha = np.where(s > 0, np.cos(p1) * np.cos(p2) * np.sin(lam) / s, 0.0)
            cos2 = 1 - alpha**2
            mid = np.where(cos2 > 1e-15, c - 2 * np.sin(p1) * np.sin(p2) / cos2, 0.0)
            k = f / 16 * cos2 * (4 + f * (4 - 3 * cos2))
            new = diff + (1 - k) * f * alpha * (sigma + k * s * (mid + k * c * (2 * mid**2 - 1)))
            done = np.nanmax(np.abs(new - lam), initial=0.0) < 1e-12
            lam = new
            if done:
                break
    u2 = cos2 * (a * a - b * b) / (b * b)
    big = 1 + u2 / 16384 * (4096 + u2 * (-768 + u2 * (320 - 175 * u2)))
    small = u2 / 1024 * (256 + u2 * (-128 + u2 * (74 - 47 * u2)))
    shift = small * s * (mid + small / 4 * (c * (2 * mid**2 - 1) - small / 6 * mid * (4 * s * s - 3) * (4 * mid**2 - 3)))
    return pd.Series(b * big * (sigma - shift))


def linearised_fst(f: Column, clip: bool = False) -> Column:
    """F / (1 - F); negative values become 0 first if `clip`. Null at 1."""
    f = F.greatest(f, F.lit(0.0)) if clip else f
    return F.when(f != 1, f / (1 - f))


def log_km(km: Column, any_zero: Column) -> Column:
    """ln(km), or ln(km + 1) for all pairs if some distance of the set is zero."""
    return F.when(any_zero, F.log1p(km)).otherwise(F.log(km))


def mean_tree_support(tree: Column) -> Column:
    """Mean of the support labels `)NN:` of a tree; unlabelled nodes are ignored; null if none."""
    found = F.transform(F.regexp_extract_all(tree, F.lit(r"\)([0-9]+):"), F.lit(1)), lambda x: x.cast("double"))
    return F.when(F.size(found) > 0, F.aggregate(found, F.lit(0.0), lambda s, x: s + x) / F.size(found))


def concordance_factors(tree: Column, kind: str = "s") -> Column:
    """Arrays of numbers of each sCF/sDF1/sDF2 (kind s) or gCF/gDF1/gDF2/gDFP (kind g) comment.

    A comment of zeros alone is null.
    """
    names = "sCF/sDF1/sDF2" if kind == "s" else "gCF/gDF1/gDF2/gDFP"
    found = F.regexp_extract_all(tree, F.lit(names + r'="([^"]*)"'), F.lit(1))
    numbers = F.transform(found, lambda x: F.transform(F.split(x, "/"), lambda y: y.try_cast("double")))
    return F.transform(numbers, lambda x: F.when(F.exists(x, lambda y: y != 0), x))


def yule_lambda(height: Column, n: Column) -> Column:
    """Birth rate of a Yule tree of n tips: sum over k of k / (n (n - k)), over the height; 1 decimal."""
    total = F.aggregate(F.sequence(F.lit(1), n - 1), F.lit(0.0), lambda s, k: s + k / (n * (n - k)))
    return F.round(total / height, 1)
