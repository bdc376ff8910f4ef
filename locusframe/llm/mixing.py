"""Mixing of sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import BROADCAST_ROWS, materialize, release, words

#: Parts of the range of ranks that are summed for each source before single documents are looked at.
RANKS = 4096
#: Times that the ranking goes on after a document that no longer fits.
ROUNDS = 4
_UNIT = float(1 << 52)


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Target of each source, from (source, source_size, further columns, which stay).

    Sources in order of their code points, null last, weigh `weights`, repeating. Together they
    get `share` of all sizes. A target above `most` times its source's size stops there; what is
    over is shared by weight among the others, until none is above: the level of a water filling,
    found by aggregates over the table of sources. Sources are dealt to tasks by range and numbered
    from the tasks' counts. Adds target.
    """
    order = [F.col("source").isNull(), F.encode("source", "utf-8")]
    spark = sizes.sparkSession
    dealt = materialize(sizes.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("_part", F.spark_partition_id()))
    ws = F.array(*[F.lit(float(w)) for w in weights])
    # One row per task: how many sources the tasks before it have.
    before = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    rank = F.row_number().over(W.partitionBy("_part").orderBy(*order)) - 1 + F.col("_before")
    ranked = materialize(dealt.join(F.broadcast(before), "_part").withColumn("_weight", F.get(ws, F.pmod(rank, F.lit(len(weights))).cast("int"))).drop("_part", "_before"))
    release(dealt)
    cap = F.lit(float(most)) * F.col("source_size")
    total = ranked.agg(F.sum("source_size").alias("s")).first()["s"] or 0
    left, level = float(share) * total, float("inf")
    while True:
        # Level at which the sources that are not capped share what the capped ones leave.
        at = cap > F.lit(level) * F.col("_weight")
        row = ranked.agg(
            F.sum(F.when(at, F.col("_weight"))).alias("w"), F.sum(F.when(~at, cap)).alias("c"), F.sum("_weight").alias("all")
        ).first()
        if level == float("inf"):
            new = left / row["all"] if row["all"] else 0.0
        else:
            new = (left - (row["c"] or 0.0)) / row["w"] if row["w"] else level
        if level != float("inf") and new <= level * (1 + 1e-12):
            break
        level = new
    return ranked.withColumn("target", F.least(cap, F.lit(level) * F.col("_weight"))).drop("_weight")


def chance(doc_id: Column, text: Column, seed: int) -> Column:
    """A repeatable number in (0, 1): 52 bits of the MD5 of the seed, the id and the text."""
    mark = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))))
    return (F.conv(F.substring(mark, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(_UNIT)


def weight(size: Column) -> Column:
    """What a document's inclusion is proportional to: the root of its size, as a whole number."""
    return F.floor(F.sqrt(size.cast("double")) * 1024)


def pareto_rank(u: Column, inclusion: Column) -> Column:
    """Place in the Pareto ranking, 0 to 2**52: from the odds of u divided by the odds of inclusion."""
    p = F.least(F.lit(1 - 1e-9), inclusion)
    q = (u / (1 - u)) / (p / (1 - p))
    return F.floor(q / (1 + q) * F.lit(_UNIT))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _cut(docs: DataFrame, state: DataFrame) -> DataFrame:
    """Where each source's ranking stops: the first place whose words, added to those before it, exceed what is due.

    `docs`: source, size, rank, tie. `state`: source, due (a long), and from which (rank, tie) on, this
    excluded. Documents larger than what is due are passed over. Returns the state, with the place
    (rank, tie) of the cut, null if all fits, and the words before it. Sums over RANKS parts of the
    range come first; only the documents of the part with the cut are put in order.
    """
    by = state.select(F.col("source").alias("_s"), "due", "from_rank", "from_tie")
    part = F.floor(F.col("rank") / F.lit(_UNIT / RANKS)).cast("int")
    after = (F.col("rank") > F.col("from_rank")) | (F.col("rank") == F.col("from_rank")) & (F.col("tie") > F.col("from_tie"))
    open_ = docs.join(_small(by), F.col("source").eqNullSafe(F.col("_s"))).where((F.col("size") <= F.col("due")) & after).withColumn("part", part)
    sums = open_.groupBy("source", "part").agg(F.sum("size").alias("words"), F.max("due").alias("due"))
    upto = F.sum("words").over(W.partitionBy("source").orderBy("part"))  # RANKS rows of a source at most
    sums = sums.withColumn("upto", upto)
    found = materialize(
        sums.groupBy("source").agg(
            F.min(F.when(F.col("upto") > F.col("due"), F.struct("part", (F.col("upto") - F.col("words")).alias("before")))).alias("x"), F.sum("words").alias("all"))
        .select(F.col("source").alias("_f"), "x.part", "x.before", "all")
    )
    own = found.where("part is not null").select("_f", F.col("part").alias("_p"), "before")
    inside = open_.join(_small(own), F.col("source").eqNullSafe(F.col("_f")) & (F.col("part") == F.col("_p")))
    # Rows that are equal in id and text have one place, and are taken or left together.
    inside = inside.groupBy("source", "rank", "tie").agg(F.sum("size").alias("words"), F.max("due").alias("due"), F.max("before").alias("before"))
    run = F.col("before") + F.sum("words").over(W.partitionBy("source").orderBy("rank", "tie"))
    inside = inside.withColumn("run", run).where(F.col("run") > F.col("due"))
    cuts = inside.groupBy("source").agg(F.min(F.struct("rank", "tie", (F.col("run") - F.col("words")).alias("took"))).alias("c")).select(F.col("source").alias("_c"), "c.*")
    return (
        state.join(found.select("_f", "all"), F.col("source").eqNullSafe(F.col("_f")), "left").join(cuts, F.col("source").eqNullSafe(F.col("_c")), "left")
        .withColumn("took", F.coalesce("took", "all", F.lit(0).cast("long"))).drop("_f", "_c", "all")
    )


def mix(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """Documents with the copies that a mix of their sources takes.

    `docs` has doc_id, text and source; other columns, of any name, pass through, but for the four
    that are added. A document's size is its number of words. With r the ratio of a source's target
    to its size, each document gets floor(r) certain whole copies. The words still due come from a
    Pareto sample of the source: a document's inclusion is proportional to the root of its size, so
    that longer documents are likelier to be repeated, but less than by their length; documents are
    ranked by the odds of a repeatable random number divided by the odds of their inclusion, and
    the first of them get a further copy, as many as their words allow. After one that no longer
    fits the ranking goes on with those that do, `ROUNDS` times at most, so the words taken end near
    the target where a source has documents small enough. Cuts are found by sums over parts of the
    ranking; no source is put in one task.

    Null or empty text: size 0, taken 0. Null source: a source of its own, the last. Empty table:
    no rows. Repeated rows are documents of their own; rows equal in doc_id and text have one place
    in the ranking and get equal copies. Adds _size, _source_size, _target, _copies.
    """
    added = ("_size", "_source_size", "_target", "_copies")
    columns = [c for c in docs.columns if c not in added]
    src = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"))
    src = src.select("row", F.col("row.source").alias("source"), F.coalesce(F.size(words("row.text")), F.lit(0)).cast("long").alias("size"),
                     chance(F.col("row.doc_id"), F.col("row.text"), seed).alias("u"), F.xxhash64("row.doc_id", "row.text").alias("tie"))
    slim = materialize(src.drop("row"))
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(weight(F.col("size")) * F.col("size")).alias("mass"))
    targets = source_targets(sizes, weights, share, most)
    # A ratio within rounding of a whole number is that number.
    ratio = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    whole = F.floor(ratio + 1e-9)
    due = F.greatest(F.lit(0).cast("long"), F.floor(F.col("target") - whole * F.col("source_size") + 1e-6))
    plan = targets.withColumn("whole", whole).withColumn("due", due).withColumn("per", F.when(F.col("mass") > 0, F.col("due") / F.col("mass")).otherwise(0.0))
    plan = materialize(plan.select("source", "source_size", "target", "whole", "per", F.col("due").alias("left")))

    def placed(df: DataFrame) -> DataFrame:
        """`df` with its source's plan, and the place in the ranking."""
        by = _small(plan.withColumnRenamed("source", "_s"))
        joined = df.join(by, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
        return joined.withColumn("rank", pareto_rank(F.col("u"), F.greatest(F.lit(1e-9), F.col("per") * weight(F.col("size")))))

    ranked = materialize(placed(slim.where("size > 0")).where("left > 0").select("source", "size", "rank", "tie"))
    start = (F.lit(-1).cast("long"), F.lit(0).cast("long"))
    state = plan.where("left > 0").select("source", F.col("left").alias("due"), start[0].alias("from_rank"), start[1].alias("from_tie"))
    spans = None
    for _ in range(ROUNDS):
        done = materialize(_cut(ranked, state))
        span = done.select("source", F.struct("from_rank", "from_tie", F.col("rank").alias("to_rank"), F.col("tie").alias("to_tie"), "due").alias("span"))
        spans = span if spans is None else spans.unionByName(span)
        state = done.where("rank is not null and due > took").select("source", (F.col("due") - F.col("took")).alias("due"), F.col("rank").alias("from_rank"), F.col("tie").alias("from_tie"))
    spans = materialize(spans.groupBy("source").agg(F.collect_list("span").alias("spans")))  # ROUNDS of a source at most
    release(ranked, slim)

    out = placed(src).join(_small(spans.withColumnRenamed("source", "_s")), F.col("source").eqNullSafe(F.col("_s")), "left")
    after = lambda a, b, c, d: (a > c) | (a == c) & (b > d)
    within = lambda s: (F.col("size") <= s["due"]) & after(F.col("rank"), F.col("tie"), s["from_rank"], s["from_tie"]) & (s["to_rank"].isNull() | after(s["to_rank"], s["to_tie"], F.col("rank"), F.col("tie")))
    extra = (F.col("size") > 0) & F.coalesce(F.exists("spans", within), F.lit(False))
    copies = F.when(F.col("size") > 0, F.least(F.col("whole") + extra.cast("int"), F.lit(int(most)))).otherwise(F.col("whole")).cast("int")
    # In a step of its own: a name inside the lambda must not meet a user's column of that name.
    out = out.select("row", "size", "source_size", "target", copies.alias("copies"))
    return out.select(*[F.col("row")[c].alias(c) for c in columns], F.col("size").alias("_size"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), F.col("copies").alias("_copies"))
