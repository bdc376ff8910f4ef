"""Candidate pairs from buckets, and connected components, by DataFrame operations."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, release

#: Members of a bucket that one task compares with each other, and rows that a task gets at a time.
BLOCK, GROUP_ROWS = 1024, 4000


def star_pairs(rows: DataFrame, related: Column) -> DataFrame:
    """Distinct pairs (a, b) of each bucket's members a with its pivot b.

    `rows` has key, node, meta and rank; the pivot is the member of the greatest rank. As many pairs
    as rows at most, however large the bucket. `related` is a condition on x_meta and y_meta.
    """
    pivots = rows.groupBy("key").agg(F.max(F.struct("rank", "node", "meta")).alias("p"), F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo != hi")
    found = rows.select("key", F.col("node").alias("a"), F.col("meta").alias("x_meta")).join(pivots.select("key", F.col("p.node").alias("b"), F.col("p.meta").alias("y_meta")), "key")
    return found.where((F.col("a") != F.col("b")) & related).select("a", "b").distinct()


def split_buckets(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The buckets of `rows` (key, node, further columns) whose n members lie in several components, equal buckets once.

    `labels`: node, comp; a node without a label, or all without labels, is a component of its own. Many
    keys of two similar sets have the same members: of buckets with as many members and equal 128-bit
    sums of their hashes, one stays. Adds comp and n.
    """
    if labels is None:
        placed = rows.withColumn("comp", F.col("node"))
    else:
        named = labels.select(F.col("node").alias("_n"), F.col("comp").alias("_c"))
        placed = rows.join(named, F.col("node") == F.col("_n"), "left").withColumn("comp", F.coalesce("_c", "node")).drop("_n", "_c")
    keys = placed.groupBy("key").agg(
        F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"),
    ).where("lo != hi")
    once = keys.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key", "n")
    return materialize(placed.join(once, "key"))


def in_blocks(placed: DataFrame, payload: DataFrame | None, find: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """Distinct rows that `find` makes of whole buckets, in tasks.

    `placed` comes from `split_buckets`; `payload` has node and what `find` needs besides. Tasks get
    about `GROUP_ROWS` rows at a time. A bucket of more than `BLOCK` members is dealt to blocks, and each
    two of its blocks meet, so no task holds an unbounded bucket; members are compared in the tasks, and
    only what is found becomes rows. `find` gets the rows, by bucket, and the bounds of the buckets.
    """
    groups = max(1, -(-placed.count() // GROUP_ROWS))
    dealt = placed.withColumn("_blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("_i", F.pmod(F.xxhash64("node", F.lit(3)), F.col("_blocks")).cast("int"))
    large = dealt.where("_blocks > 1").withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    dealt = dealt.where("_blocks = 1").withColumn("_j", F.lit(0)).unionByName(large).drop("_blocks", "n")
    dealt = dealt.withColumn("_lo", F.least("_i", "_j")).withColumn("_hi", F.greatest("_i", "_j")).drop("_i", "_j")
    dealt = dealt.withColumn("_g", F.pmod(F.xxhash64("key", "_lo", "_hi"), F.lit(groups)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "_lo", "_hi", "node"], ignore_index=True)
        part = pdf[["key", "_lo", "_hi"]].to_numpy()
        return find(pdf, np.r_[0, np.flatnonzero((part[1:] != part[:-1]).any(1)) + 1, len(pdf)])

    dealt = dealt if payload is None else dealt.join(payload, "node")
    return dealt.groupBy("_g").applyInPandas(run, schema).distinct()


def compared(placed: DataFrame, payload: DataFrame, compare: Callable[[pd.DataFrame, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Distinct pairs (a, b) of nodes that `compare` finds, as numbers of rows, among the members of each bucket."""

    def find(pdf: pd.DataFrame, bounds: np.ndarray) -> pd.DataFrame:
        i, j = compare(pdf, bounds)
        node = pdf.node.to_numpy(np.int64)
        return pd.DataFrame({"a": np.minimum(node[i], node[j]), "b": np.maximum(node[i], node[j])}).drop_duplicates()

    return in_blocks(placed, payload, find, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the least node reachable, for each node that an edge (a, b) names.

    Labels pass along the edges, then each node takes its label's label, until nothing changes; every
    round is written to the shared folder. Rounds grow with the logarithm of a chain's length.
    Null ends are left out. No edges: no rows.
    """
    both = edges.where("a is not null and b is not null and a != b").select("a", "b")
    both = materialize(both.union(both.select("b", "a")).distinct())
    stored = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")))
    while True:
        labels = stored.select("node", "comp")
        ahead = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("m"))
        near = labels.join(ahead, "node").select("node", F.col("comp").alias("old"), F.least("comp", "m").alias("comp"))
        jump = labels.select(F.col("node").alias("_n"), F.col("comp").alias("far"))
        new = materialize(near.join(jump, F.col("comp") == F.col("_n")).select("node", "old", F.least("comp", "far").alias("comp")))
        release(stored)
        stored = new
        if new.where("comp != old").limit(1).count() == 0:
            release(both)
            return new.select("node", "comp")
