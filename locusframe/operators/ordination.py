"""Principal components of samples."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .planes import Planes, dosages, from_packed


#: Columns of a block that is iterated, rounds of it at most, and the change of axes (sine of the angle) at which it stops.
COLUMNS, ROUNDS, ENOUGH = 64, 300, 1e-9


def _centred(g: np.ndarray, standardise: bool) -> np.ndarray:
    """Dosages, sites x samples, -1 for missing, centred by site with missing ones at the mean; sites without a call are zero."""
    known = g >= 0
    n = known.sum(1, keepdims=True)
    mean = np.where(known, g, 0).sum(1, keepdims=True) / np.maximum(n, 1)
    x = np.where(known, g - mean, 0.0)
    if standardise:
        scale = np.sqrt(mean / 2 * (1 - mean / 2))
        x = np.divide(x, scale, out=np.zeros_like(x), where=scale > 0)
    return x


def _multiplied(planes: Planes, block: np.ndarray, standardise: bool) -> tuple[np.ndarray, float]:
    """X'X times a block of vectors (samples x columns), and the sum of squares of X; X is never held.

    Tasks add up products of their sites; rows for samples are summed by Spark in two steps.
    """
    n, names = planes.n, [f"p{a}" for a in range(planes.alleles)]
    shared = planes.sites.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc, squares = np.zeros_like(shared.value), 0.0
        for pdf in batches:
            for a in range(0, len(pdf), 1024):
                x = _centred(dosages(pdf.iloc[a : a + 1024], n, names), standardise)
                acc += x.T @ (x @ shared.value)
                squares += float((x * x).sum())
        yield pd.DataFrame({"y": [acc.tobytes()], "squares": [squares]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"y": [sum(np.frombuffer(y) for y in pdf.y).tobytes()], "squares": [pdf.squares.sum()]})

    schema = "y binary, squares double"
    parts = planes.sites.select(*planes.columns).mapInPandas(run, schema)
    tasks = parts.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(16))).groupBy("salt").applyInPandas(lambda pdf: add(pdf), schema)
    rows = tasks.collect()  # 16 blocks of samples x columns at most
    shared.destroy()
    return sum((np.frombuffer(r["y"]).reshape(block.shape) for r in rows), np.zeros_like(block)), sum(r["squares"] for r in rows)


def subspace(planes: Planes, k: int, standardise: bool = False, columns: int | None = None, seed: int = 1) -> tuple[np.ndarray, np.ndarray, float]:
    """(values, vectors, total) of the k greatest eigenvalues of X'X / n over samples, and the sum of all.

    A random block of `columns` vectors is multiplied by the sites' blocks in turn and made orthogonal, in rounds,
    until the first k axes rest. For samples up to the block's columns the first round is exact. The driver holds
    samples x columns, never samples x samples.
    """
    n = planes.n
    q = min(n, max(k + 8, COLUMNS if columns is None else columns))
    block = np.eye(n) if q == n else np.linalg.qr(np.random.default_rng(seed).normal(0, 1, (n, q)))[0]
    axes = None
    for _ in range(1 if q == n else ROUNDS):
        y, squares = _multiplied(planes, block, standardise)
        values, turn = np.linalg.eigh((block.T @ y + y.T @ block) / 2)
        order = np.argsort(values)[::-1]
        new = block @ turn[:, order[:k]]
        rest = 1.0 if axes is None else float(np.abs(new - axes @ (axes.T @ new)).max(initial=0))
        axes, values = new, values[order]
        if rest < ENOUGH:
            break
        block = np.linalg.qr(y @ turn[:, order])[0]
    return np.maximum(values[:k], 0) / n, axes, squares / n


def components(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues (greatest first), scores of the first k axes, and percent of variance (1 decimal)."""
    values, vectors = np.linalg.eigh((matrix + matrix.T) / 2)
    order = np.argsort(values)[::-1]
    values, vectors = np.maximum(values[order], 0), vectors[:, order]
    return values, vectors[:, :k] * np.sqrt(values[:k] * len(matrix)), np.round(100 * values / max(values.sum(), 1e-300), 1)


def pca(planes: Planes | DataFrame, samples: list[str], k: int = 3, standardise: bool = False, columns: int | None = None) -> DataFrame:
    """(sample, axis, score, percent) of the first k axes, from planes or packed sites; the sign of an axis is free. No sites: scores and shares of zero.

    Dosages are centred by site, missing ones at the mean; `standardise` divides by sqrt(p (1 - p)). Half calls are missing.
    The planes are written once and read in each round.
    """
    planes = from_packed(planes, len(samples)) if isinstance(planes, DataFrame) else planes
    n, k = planes.n, min(k, planes.n)
    if n > (COLUMNS if columns is None else columns):
        planes = replace(planes, sites=written(planes.sites.select(*planes.columns)))
    values, axes, total = subspace(planes, k, standardise, columns)
    scores, percent = axes * np.sqrt(values * n), np.round(100 * values / max(total, 1e-300), 1)
    rows = [(s, a + 1, float(scores[i, a]), float(percent[a])) for i, s in enumerate(samples) for a in range(k)]
    return planes.sites.sparkSession.createDataFrame(rows, "sample string, axis int, score double, percent double")


def pca_from_covariance(spark, matrix: np.ndarray, samples: list[str], k: int = 3) -> DataFrame:
    """The same table from a given covariance matrix."""
    _, scores, percent = components(matrix, k)
    rows = [(s, a + 1, float(scores[i, a]), float(percent[a])) for i, s in enumerate(samples) for a in range(scores.shape[1])]
    return spark.createDataFrame(rows, "sample string, axis int, score double, percent double")
