"""Exact top-k search by columnar branch and bound."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import materialize, release

#: Bytes of the queries that are broadcast at a time, vectors of a data block, queries of a block of them, and
#: dimensions of a vertical block.
QUERY_BYTES, DATA_BLOCK, QUERY_BLOCK, DIMS = 8 << 20, 4096, 128, 16
#: Inner products are summed in doubles where they surely stay below this, else as whole numbers.
EXACT = 2.0**52
#: The ends of the longs, at which greater scores are held.
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def quantized(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id and q: floor(scale * x) of every component, as array<double> of whole numbers.

    Vectors that are null, or hold a null or a component that is not finite, are left out, and so
    are rows without a vec_id.
    """
    x = F.transform("embedding", lambda v: v.cast("double"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double") * scale) < F.lit(float("inf"))))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False))).select(
        # A floor of a double beyond the longs would stop there; from 2**52 on doubles are whole.
        F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: F.when(F.abs(v * scale) < 2.0**52, F.floor(v * scale).cast("double")).otherwise(v * scale)).alias("q")
    )


def search_block(qid: np.ndarray, q: np.ndarray, floor: np.ndarray, vid: np.ndarray, v: np.ndarray, k: int, dims: int = DIMS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exact best k of the block's vectors for each query that reach its floor: (query number, vector id, score).

    The vectors lie in vertical blocks of `dims` dimensions. For each query the partial inner
    products grow block by block; a candidate whose partial sum plus the bound of its remaining
    mass (the product of both remaining lengths, by Cauchy and Schwarz) stays under the query's
    floor, or under the k-th best lower bound here, is dropped, and the survivors are compacted. A
    candidate equal to the bound stays, so ties are decided by the id alone. Rows with the query's
    id are not its candidates.
    """
    n, d = v.shape
    cuts = list(range(0, d, dims)) + [d]
    blocks = [np.ascontiguousarray(v[:, a:b]) for a, b in zip(cuts, cuts[1:])]
    rest, qrest = np.zeros((len(cuts), n)), np.zeros((len(cuts), len(q)))
    for i in range(len(cuts) - 2, -1, -1):
        rest[i] = rest[i + 1] + (blocks[i] ** 2).sum(1)
        qrest[i] = qrest[i + 1] + (q[:, cuts[i] : cuts[i + 1]] ** 2).sum(1)
    rest, qrest = np.sqrt(rest), np.sqrt(qrest)
    whole = d == 0 or float(rest[0].max(initial=0)) * float(qrest[0].max(initial=0)) < EXACT
    outs, scores, owners = [], [], []
    for a in range(0, len(q), QUERY_BLOCK):
        # The first vertical block for all queries of a block at once.
        first = q[a : a + QUERY_BLOCK, cuts[0] : cuts[1]] @ blocks[0].T if blocks else np.zeros((len(q[a : a + QUERY_BLOCK]), n))
        for j in range(a, min(a + QUERY_BLOCK, len(q))):
            part = first[j - a]
            alive = np.flatnonzero((part + rest[1] * qrest[1][j] >= floor[j] - 1e-6 * (1 + abs(floor[j]))) & (vid != qid[j])) if blocks else np.flatnonzero(vid != qid[j])
            part = part[alive]
            for i in range(1, len(cuts)):
                slack = rest[i][alive] * qrest[i][j]
                bound = floor[j]
                if len(alive) > k:
                    bound = max(bound, np.partition(part - slack, len(alive) - k)[len(alive) - k])
                keep = part + slack >= bound - 1e-6 * (1 + abs(bound))
                alive, part = alive[keep], part[keep]
                if i < len(blocks):
                    part = part + blocks[i][alive] @ q[j, cuts[i] : cuts[i + 1]]
            if not whole:  # sums beyond the doubles' whole numbers: Python's are exact
                own = [int(x) for x in q[j]]
                exact = [min(max(sum(x * int(y) for x, y in zip(own, v[i])), LEAST), MOST) for i in alive.tolist()]
                best = sorted(range(len(alive)), key=lambda i: (-exact[i], vid[alive[i]]))[:k]
                scores += [exact[i] for i in best]
            else:
                best = np.lexsort((vid[alive], -part))[:k]
                scores += np.rint(part[best]).astype(np.int64).tolist()
            outs.append(vid[alive[best]])
            owners.append(np.full(len(best), j))
    return (np.concatenate(owners), np.concatenate(outs), np.array(scores, np.int64)) if outs else (np.zeros(0, np.int64),) * 3


def _kept(owner: np.ndarray, vid: np.ndarray, score: np.ndarray, k: int, floor: np.ndarray):
    """Best k of each query, and with them the floor: the k-th score, where there are k."""
    order = np.lexsort((vid, -score, owner))
    owner, vid, score = owner[order], vid[order], score[order]
    place = np.arange(len(owner)) - np.searchsorted(owner, owner)
    keep = place < k
    last = place == k - 1
    floor = floor.copy()
    floor[owner[last]] = np.maximum(floor[owner[last]], np.where(score[last] == LEAST, -np.inf, score[last]))
    return owner[keep], vid[keep], score[keep], floor


def _search(data: DataFrame, queries, k: int) -> DataFrame:
    """(query, vec_id, score): each task's best k for the broadcast queries, block after block of its vectors.

    What a block has found raises the queries' floors for the next ones.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, qid, q, floor = queries.value
        owner = vid = score = np.zeros(0, np.int64)
        floor = floor.copy()
        for pdf in batches:
            pdf = pdf[pdf.q.map(len).to_numpy() == q.shape[1]]
            for a in range(0, len(pdf), DATA_BLOCK):
                part = pdf.iloc[a : a + DATA_BLOCK]
                found = search_block(qid, q, floor, part.vec_id.to_numpy(np.int64), np.stack(part.q.to_numpy()), k)
                owner, vid, score, floor = _kept(*(np.r_[x, y] for x, y in zip((owner, vid, score), found)), k, floor)
        yield pd.DataFrame({"query": number[owner], "vec_id": vid, "score": score})

    return data.mapInPandas(run, "query long, vec_id long, score long")


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64) -> DataFrame:
    """The k rows of highest inner product for each row whose vec_id is divisible by `every`.

    Queries, distinct ones, are numbered and broadcast `QUERY_BYTES` at a time (a stated query set
    against all rows, in blocks); the vectors stay where they are and are searched by `search_block`.
    A first pass over a small part of the vectors, by hash, gives each query a floor, its k-th score
    there; the second pass searches the others with it. The best k of a query in each task are merged.

    Ties: smaller vec_id. Fewer than k other rows: all of them. Rows of one vec_id are not each
    other's candidates. A vec_id divisible by `every` whose rows differ has a query for each
    different vector: each comes out, the ranks of each from 1, told apart by nothing but their
    scores; equal rows are one query. Repeated rows are candidates each. Vectors of another length
    than the query's are not compared. Null or non-finite vectors take no part. Scores are exact;
    one beyond 64 bits counts as the nearest long. Empty table: no rows. Returns query_id, rank, vec_id, score.
    """
    data = materialize(quantized(vectors, scale))
    spark, rows = data.sparkSession, data.count()
    wanted = materialize(data.where(F.col("vec_id") % every == 0).distinct().select("vec_id", "q", F.size("q").alias("d"), F.monotonically_increasing_id().alias("query")))
    # Queries come to the driver one bounded part at a time.
    shapes = wanted.groupBy("d").count().collect()
    share = max(1, rows // (1 << 14))
    few = F.pmod(F.xxhash64("vec_id", "q"), F.lit(share)) == 0
    found = None
    for d, count in shapes:
        parts = -(-count * max(1, d) * 8 // QUERY_BYTES)
        for p in range(parts):
            own = wanted.where((F.col("d") == d) & (F.pmod(F.xxhash64("query"), F.lit(parts)) == p)).select("query", "vec_id", "q").toPandas()
            if not len(own):
                continue
            number, qid, q = own["query"].to_numpy(np.int64), own.vec_id.to_numpy(np.int64), np.stack(own.q.to_numpy()).astype(np.float64).reshape(len(own), d)
            floor = np.full(len(own), -np.inf)
            shared = spark.sparkContext.broadcast((number, qid, q, floor))
            best = W.partitionBy("query").orderBy(F.desc("score"), "vec_id")
            first = materialize(_search(data.where(few), shared, k).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k))
            at = first.where(F.col("rank") == k).select("query", "score").toPandas()
            place = pd.Index(number).get_indexer(at["query"])
            floor[place] = np.where(at.score == LEAST, -np.inf, at.score.to_numpy(np.float64))
            shared.destroy()
            shared = spark.sparkContext.broadcast((number, qid, q, floor))
            rest = materialize(_search(data.where(~few), shared, k))
            shared.destroy()
            both = first.drop("rank").unionByName(rest).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            both = materialize(both.join(wanted.select("query", F.col("vec_id").alias("query_id")), "query").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
            release(first, rest)
            found = both if found is None else found.unionByName(both)
    release(data, wanted)
    return found if found is not None else spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
