"""Helpers shared by the operators: shared storage, checked broadcasts, reading of tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows up to which a table that was counted first is broadcast; beyond it, it is shuffled.
BROADCAST_ROWS = 50_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`.

    Where a local session names none, as in a test, a folder of this machine is set; on a cluster,
    where executors do not see such a folder, that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: With it, a statement's shuffle files are removed when it ends; a written table does not need them.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def without_shuffle_files(spark: SparkSession) -> Iterator[None]:
    """Statements within leave no shuffle files behind."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame) -> DataFrame:
    """Write `df` once as Parquet in the shared folder and read it again.

    This cuts the lineage, survives lost executors and gives later stages real sizes. The shuffle
    files behind the table go as soon as it is written; `release` removes the table.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    with without_shuffle_files(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.materialized_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Remove tables that `materialize` wrote and that no plan still to be run reads."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.materialized_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """Materialize `df`, and mark it for broadcasting if its counted rows are at most `limit`."""
    df = materialize(df)
    fits = df.limit(limit + 1).count() <= limit
    out = F.broadcast(df) if fits else df
    out.materialized_at = df.materialized_at
    return out, fits


def lower_ascii(text: Column | str) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column | str) -> Column:
    """Array of the words of a text, runs without ASCII white space; null for null.

    One translation and a split at single spaces, several times as fast as a pattern.
    """
    return F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", " " * 5), " "), "")


def held_out(doc_id: Column | str, divisor: int, remainder: int = 2) -> Column:
    """True where crc32(doc_id as text) mod `divisor` is `remainder`; false for a null id."""
    key = F.crc32(F.encode(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"), "utf-8"))
    return F.coalesce(key % divisor == remainder, F.lit(False))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, through Spark's reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def total_bytes(df: DataFrame, column: str) -> tuple[int, int]:
    """Rows, and bytes of all texts of a column."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(column).cast("long")).alias("b")).first()
    return row["n"], row["b"] or 0


#: Bits of a map of hashes: 2**MAP_BITS / 8 bytes at most, whatever the input.
MAP_BITS = 27
#: Rows in which the map comes to the driver.
MAP_PARTS = 256


def hash_map(hashes: DataFrame, column: str, bits: int = MAP_BITS) -> np.ndarray:
    """A map of 2**bits bits with the leading bits of 64-bit hashes set, made by Spark.

    Its size is fixed, so it may be broadcast; it has false positives only.
    """
    bit = hashes.select(F.shiftrightunsigned(column, 64 - bits).alias("i")).selectExpr("i >> 6 as w", "shiftleft(1L, cast(i & 63 as int)) as b")
    words = bit.groupBy("w").agg(F.bit_or("b").alias("b"))
    size = max(1, (1 << (bits - 6)) // MAP_PARTS)

    def part(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(size, np.int64)
        w = pdf.w.to_numpy(np.int64)
        out[w % size] = pdf.b.to_numpy(np.int64)
        return pd.DataFrame({"part": [w[0] // size], "bits": [out.tobytes()]})

    out = np.zeros(((1 << (bits - 6)) // size, size), np.int64)
    with without_shuffle_files(hashes.sparkSession):
        rows = words.groupBy(F.floor(F.col("w") / size)).applyInPandas(part, "part long, bits binary").collect()
    for r in rows:
        out[r["part"]] = np.frombuffer(r["bits"], np.int64)
    return out.ravel()


def repeated_map(packed: DataFrame, column: str, keys: int) -> np.ndarray:
    """A map like that of `hash_map`, of the 64-bit hashes that occur more than once among the arrays packed in a binary column.

    `keys`: about how many there are in all. They are dealt to tasks by their leading bits, packed, some
    200000 to a group, and sorted there.
    """
    parts = 1 << max(4, min(20, int(keys // 200_000).bit_length()))
    lead = np.uint64(64 - parts.bit_length() + 1)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            h = np.sort(np.frombuffer(b"".join(pdf[column]), np.uint64))
            cuts = np.searchsorted(h >> lead, np.arange(parts + 1, dtype=np.uint64)).tolist()
            found = [(p, h[a:b].tobytes()) for p, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
            yield pd.DataFrame(found, columns=["part", "keys"])

    def mark(pdf: pd.DataFrame) -> pd.DataFrame:
        h = np.sort(np.frombuffer(b"".join(pdf["keys"]), np.uint64))
        bit = h[1:][h[1:] == h[:-1]] >> np.uint64(64 - MAP_BITS)
        if not len(bit):
            return pd.DataFrame({"w": [b""], "b": [b""]})
        word = bit >> np.uint64(6)
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        bits = np.bitwise_or.reduceat(np.left_shift(np.uint64(1), bit & np.uint64(63)), first)
        return pd.DataFrame({"w": [word[first].tobytes()], "b": [bits.tobytes()]})

    out = np.zeros(1 << (MAP_BITS - 6), np.int64)
    with without_shuffle_files(packed.sparkSession):
        rows = packed.select(column).mapInPandas(deal, "part int, keys binary").groupBy("part").applyInPandas(mark, "w binary, b binary").collect()
    for r in rows:  # of fixed size together, about twice the map's
        w = np.frombuffer(r["w"], np.int64)
        out[w] |= np.frombuffer(r["b"], np.int64)
    return out


def in_map(map_: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each 64-bit hash (unsigned) may be in the map."""
    i = hashes >> np.uint64(64 - (len(map_).bit_length() + 5))
    return (map_[(i >> np.uint64(6)).astype(np.int64)].view(np.uint64) >> (i & np.uint64(63))) & np.uint64(1) == 1
