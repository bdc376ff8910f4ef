"""Exact order statistics without a sort: counts of ranges say in which one a rank lies, and only that one is looked into."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Ranges that a step counts, and rows of a range that are put in order at last.
RANGES, FEW = 4096, 10_000


def kth_long(df: DataFrame, key: Column, k: int) -> tuple[int, int, int]:
    """(value, rows below it, rows of it) of the k-th least of a column of longs, k from 1 to the number of rows.

    Each step counts RANGES ranges of the numbers that are left, up to six times for 64 bits; counts alone reach the driver.
    """
    rows = df.select(key.cast("long").alias("x")).where("x is not null")
    lo, hi = rows.agg(F.min("x"), F.max("x")).first()
    below = 0
    while True:
        step = max(1, -(-(hi - lo + 1) // RANGES))
        # Differences of longs may leave 64 bits: decimals hold them, and `div` rounds down exactly.
        place = F.expr(f"cast((cast(x as decimal(21,0)) - cast('{lo}' as decimal(21,0))) div cast('{step}' as decimal(21,0)) as int)")
        counts = sorted((r["p"], r["n"]) for r in rows.where(F.col("x").between(lo, hi)).groupBy(place.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
        for p, n in counts:
            if below + n >= k:
                break
            below += n
        lo, hi = lo + p * step, min(hi, lo + (p + 1) * step - 1)
        if lo == hi:
            return lo, below, n


def smallest(df: DataFrame, n: int, key: Column, tie: Column) -> DataFrame:
    """Exactly n rows (all, if fewer) of the least key, ties by the least `tie`; both are longs. Null keys come last.

    No task holds the n rows: the last key is found by counts, then rows are filtered where they are.
    """
    if n <= 0:
        return df.limit(0)
    all_ = df.withColumn("_k", key.cast("long")).withColumn("_t", F.coalesce(tie.cast("long"), F.lit((1 << 63) - 1)))
    cut = all_.where("_k is not null")
    known = cut.count()
    if known == n:
        return cut.drop("_k", "_t")
    if known < n:  # all of these, and rows without a key by their tie
        rest = all_.where("_k is null").withColumn("_k", F.col("_t"))
        if not rest.limit(1).count():
            return cut.drop("_k", "_t")
        return cut.drop("_k", "_t").unionByName(smallest(rest.drop("_t"), n - known, F.col("_k"), F.lit(0)).drop("_k"))
    last, below, equal = kth_long(cut, F.col("_k"), n)
    if below + equal == n:
        return cut.where(F.col("_k") <= last).drop("_k", "_t")
    at = F.col("_k") == last
    edge, under, same = kth_long(cut.where(at), F.col("_t"), n - below)
    sure = cut.where((F.col("_k") < last) | (at & (F.col("_t") < edge)))
    whole = cut.where(at & (F.col("_t") == edge))
    left = n - below - under
    return sure.unionByName(whole if same == left else whole.limit(left)).drop("_k", "_t")


def quantiles(df: DataFrame, column: str, by: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """Exact quantiles of a column within each group of `by`: the columns of `by`, n, and q (array, in the order of `shares`), between neighbours in proportion.

    All groups and ranks are narrowed together: a step counts RANGES / 16 ranges of what is left of each, until a
    range holds FEW rows or one value, which are then put in order. No task holds a group. Nulls and
    NaN do not count; groups without a value are left out.
    """
    by = list(by)
    rows = df.select(*by, F.col(column).cast("double").alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    size = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    spots = size.withColumn("q", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(float(s)) * (F.col("n") - 1)).alias("at")) for i, s in enumerate(shares)])))
    wanted = spots.select(*by, "n", "lo", "hi", F.explode(F.array(F.floor("q.at"), F.ceil("q.at"))).alias("rank")).distinct().withColumn("below", F.lit(0).cast("long")).withColumn("m", F.col("n"))
    open_ = wanted.toPandas()  # a few rows for each group
    done = []
    spark, parts = df.sparkSession, RANGES // 16
    schema = wanted.schema
    while len(open_):
        few = open_[(open_.m <= FEW) | (open_.lo == open_.hi)]
        done.append(few)
        open_ = open_.drop(few.index)
        if not len(open_):
            break
        ranges = F.broadcast(spark.createDataFrame(open_, schema))
        near = rows.alias("r").join(ranges.alias("w"), [F.col(f"r.{c}").eqNullSafe(F.col(f"w.{c}")) for c in by] or F.lit(True)).where("x >= lo and x <= hi")
        place = F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * parts), F.lit(parts - 1)).cast("int")
        key = [F.col(f"w.{c}").alias(c) for c in by]
        got = near.groupBy(*key, F.col("rank"), place.alias("p")).agg(F.count(F.lit(1)).alias("c"), F.min("x").alias("lo"), F.max("x").alias("hi")).toPandas()
        got = got.sort_values([*by, "rank", "p"], ignore_index=True)
        head = open_[[*by, "n", "rank", "below"]]
        got = got.merge(head, on=[*by, "rank"], how="left") if by else got.merge(head, on="rank", how="left")
        got["end"] = got.below + got.groupby([*by, "rank"], dropna=False).c.cumsum()
        got = got[got.end > got["rank"]].groupby([*by, "rank"], dropna=False, sort=False).head(1)
        open_ = got.assign(below=got.end - got.c, m=got.c)[list(schema.names)].reset_index(drop=True)
    found = pd.concat(done, ignore_index=True) if done else open_
    known = F.broadcast(spark.createDataFrame(found, schema)) if len(found) else wanted.limit(0)
    single = known.where("lo = hi").select(*by, "rank", F.col("lo").alias("x"))
    match = [F.col(f"r.{c}").eqNullSafe(F.col(f"w.{c}")) for c in by] or F.lit(True)
    inside = rows.alias("r").join(known.where("lo < hi").alias("w"), match).where("x >= lo and x <= hi")
    order = W.partitionBy(*[f"w.{c}" for c in by], "rank").orderBy("x")  # FEW rows at most
    picked = inside.withColumn("_o", F.row_number().over(order) - 1 + F.col("below")).where(F.col("_o") == F.col("rank")).select(*[F.col(f"w.{c}").alias(c) for c in by], "rank", "x")
    value = single.unionByName(picked)
    named = spots.select(*by, "n", F.col("q.i").alias("i"), F.col("q.at").alias("at"))
    lo_, hi_ = value.withColumnsRenamed({c: f"_{c}" for c in [*by, "rank", "x"]}), value.withColumnsRenamed({c: f"__{c}" for c in [*by, "rank", "x"]})
    both = named.join(lo_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by] + [F.floor("at") == F.col("_rank")]).join(hi_, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by] + [F.ceil("at") == F.col("__rank")])
    between = F.col("_x") + (F.col("__x") - F.col("_x")) * (F.col("at") - F.floor("at"))
    return both.groupBy(*by, "n").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", between.alias("v")))), lambda s: s["v"]).alias("q"))
