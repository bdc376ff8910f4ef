"""Tables of repeated runs: best K, best runs, Q matrices, class probabilities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.sides import small_side


def evanno(runs: DataFrame) -> DataFrame:
    """Evanno's table: mean and sample sd of the likelihood per K, L', |L''| and delta K.

    One row per K; K are few, whatever the number of runs.
    """
    by_k = runs.groupBy("k").agg(F.avg("likelihood").alias("mean"), F.stddev_samp("likelihood").alias("std"))
    w = W.orderBy("k")
    got = by_k.withColumn("lprime", F.col("mean") - F.lag("mean").over(w))
    got = got.withColumn("abs_ldprime", F.abs(F.lead("lprime").over(w) - F.col("lprime")))
    return got.withColumn("delta_k", F.col("abs_ldprime") / F.nullif("std", F.lit(0.0)))


def best_runs(runs: DataFrame, n: int = 1, score: str = "score") -> DataFrame:
    """The n runs of least score of each K, ranked; ties by run."""
    return runs.withColumn("rank", F.row_number().over(W.partitionBy("k").orderBy(score, "run"))).where(F.col("rank") <= n)


def best_per_k(runs: DataFrame, score: str = "score") -> DataFrame:
    """The best run of each K, by a partial aggregate."""
    return runs.groupBy("k").agg(F.min_by("run", F.struct(score, "run")).alias("run"), F.min(score).alias("score"))


def label_q(q: DataFrame, samples: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """Rows of a Q matrix named by their place: row n belongs to the n-th sample.

    `q`: row_idx, cluster, prop; `samples`: sample_idx, sample, pop. In the order of a list of names
    (ord, id), or by population and sample. Adds place.
    """
    named = q.join(small_side(samples), q["row_idx"] == samples["sample_idx"])
    if order is not None:
        named = named.join(small_side(order), F.col("sample") == F.col("id")).withColumn("place", F.dense_rank().over(W.orderBy("ord")))
    else:
        named = named.withColumn("place", F.dense_rank().over(W.orderBy("pop", "sample")))
    return named.select("place", "sample", "pop", "cluster", "prop")


def clumpak_rows(q: DataFrame) -> DataFrame:
    """Lines of a Q table: number, id, (5), population, colon, proportions; `q`: run, place, sample, pop, cluster, prop."""
    props = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cluster", "prop"))), lambda x: F.format_string("%.4f", x["prop"])), " ")
    got = q.groupBy("run", "place", "sample", "pop").agg(props.alias("props"))
    return got.select("run", "place", F.concat_ws(" ", F.col("place").cast("string"), "sample", F.lit("(5)"), "pop", F.lit(":"), "props").alias("line"))


# The six classes of a hybrid analysis, in the order of their columns.
CLASSES = ("Pure0", "Pure1", "F1", "F2", "Bx0", "Bx1")


def class_probabilities_long(df: DataFrame, columns: list[str]) -> DataFrame:
    """(sample, class, prob) from six probability columns, renamed to the classes in order."""
    named = df.withColumnsRenamed(dict(zip(columns, CLASSES)))
    return named.unpivot(["sample"], list(CLASSES), "class", "prob")
