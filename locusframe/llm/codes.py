"""Compression of vectors to codes by product quantisation, trained by member-resident Lloyd rounds on Spark."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release

#: Parts of a vector, entries of a part's codebook, rounds of training, and vectors for each salt of an owner.
PARTS, ENTRIES, ROUNDS, OWNER_ROWS = 8, 16, 6, 1 << 16
#: Parts compared with a codebook at a time.
COMPARED = 1 << 14
#: Codebooks: for each length of vectors, the parts' entries, as arrays of whole numbers (entries, components).
Books = dict[int, list[np.ndarray]]

_OWNER = "d int, pos int, entry int, salt int, moved boolean, n long, sums array<string>, members binary"


def whole_numbers(vectors: DataFrame, scale: int = 4096) -> DataFrame:
    """The rows whose vector is neither null nor holds a null or a component that is not finite, with q: floor(scale * x) of each, exact in doubles."""
    at = lambda v: v.cast("double") * scale
    usable = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(at(v)) & (F.abs(at(v)) < F.lit(float("inf"))))
    # A floor of a double beyond the longs would stop there; from 2**52 on doubles are whole.
    q = F.transform("embedding", lambda v: F.when(F.abs(at(v)) < 2.0**52, F.floor(at(v)).cast("double")).otherwise(at(v)))
    return vectors.where(F.col("embedding").isNotNull() & F.coalesce(usable, F.lit(False))).withColumn("q", q)


def bounds(d: int, parts: int = PARTS) -> list[int]:
    """Where the parts of a vector of length d begin, and its end; equal parts if d allows it."""
    return [i * d // parts for i in range(parts + 1)]


def exact(q: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole doubles and a codebook as integers in which squared distances do not overflow: 64 bits if they fit, else Python's."""
    most = max(float(np.abs(q).max(initial=0)), float(max((abs(int(x)) for x in book.ravel()), default=0)))
    if max(1, q.shape[1]) * (2 * most + 2) ** 2 < 2.0**62:
        return q.astype(np.int64), book.astype(np.int64)
    return np.array([[int(x) for x in row] for row in q], dtype=object).reshape(q.shape), book.astype(object)


def nearest(q: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each part, ties to the lower one, and its squared distance."""
    entry, least = np.zeros(len(q), np.int64), []
    for a in range(0, len(q), COMPARED):
        x, b = exact(q[a : a + COMPARED], book)
        far = np.stack([((x - row) ** 2).sum(1) if x.shape[1] else np.zeros(len(x), np.int64) for row in b], axis=1)
        entry[a : a + COMPARED] = far.argmin(1)
        least.append(far[np.arange(len(x)), entry[a : a + COMPARED]])
    return entry, np.concatenate(least) if least else np.zeros(0, np.int64)


def _packed(d: int, pos: int, entry: int, salt: int, moved: bool, q: np.ndarray) -> tuple:
    """One row of an owner: its members, what they add up to, and how many they are."""
    small = float(np.abs(q).max(initial=0)) < 2.0**31
    sums = q.astype(np.int64).sum(0) if small else [sum(int(x) for x in c) for c in q.T]
    return d, pos, entry, salt, moved, len(q), [str(int(x)) for x in sums], (b"i" + q.astype(np.int32).tobytes()) if small else (b"d" + q.astype(np.float64).tobytes())


def _members(d: int, pos: int, packed: bytes, n: int) -> np.ndarray:
    cut = bounds(d)
    kind = np.int32 if packed[:1] == b"i" else np.float64
    return np.frombuffer(packed, kind, offset=1).astype(np.float64).reshape(n, cut[pos + 1] - cut[pos])


def _first_owners(data: DataFrame, books, salts: int) -> DataFrame:
    """All parts dealt to the owners of their first entries, packed by each task and sender's batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for d, own in pdf.groupby(pdf.q.map(len)):
                q, salt, cut, out = np.stack(own.q.to_numpy()), own.salt.to_numpy(np.int64), bounds(d), []
                for pos in range(PARTS):
                    part = q[:, cut[pos] : cut[pos + 1]]
                    to = nearest(part, books.value[d][pos])[0] * salts + salt
                    order = np.argsort(to, kind="stable")
                    for rows in np.split(order, np.flatnonzero(np.diff(to[order])) + 1):
                        entry, s = divmod(int(to[rows[0]]), salts)
                        out.append(_packed(d, pos, entry, s, True, part[rows]))
                yield pd.DataFrame(out, columns=["d", "pos", "entry", "salt", "moved", "n", "sums", "members"])

    salted = data.select("q", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int").alias("salt"))
    return salted.mapInPandas(run, _OWNER)


def _settled(moved: DataFrame) -> DataFrame:
    """Members that changed entry, at their new owners: the shuffle by (position, entry, salt), each owner's arrivals in one row."""

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        d, pos, entry, salt = (int(pdf[c].iat[0]) for c in ("d", "pos", "entry", "salt"))
        q = np.concatenate([_members(d, pos, m, n) for m, n in zip(pdf["members"], pdf.n)])
        return pd.DataFrame([_packed(d, pos, entry, salt, False, q)], columns=list(pdf.columns))

    return moved.groupBy("d", "pos", "entry", "salt").applyInPandas(gather, _OWNER)


def _stay_or_move(resident: DataFrame, books) -> DataFrame:
    """Each owner's members against the new codebook: those that stay remain in its row; the others go into a row for each new entry, with moved set."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                q = _members(r.d, r.pos, r.members, r.n)
                to = nearest(q, books.value[r.d][r.pos])[0]
                for entry in np.unique(to).tolist():
                    out.append(_packed(r.d, r.pos, entry, r.salt, entry != r.entry, q[to == entry]))
            yield pd.DataFrame(out, columns=["d", "pos", "entry", "salt", "moved", "n", "sums", "members"])

    return resident.mapInPandas(run, _OWNER)


def _updated(resident: DataFrame, books: Books) -> Books:
    """Codebooks with each entry replaced by the floor of its resident members' mean; unused entries stay.

    Owners keep what their members add up to, so only sums and counts are read here; tasks add theirs up first.
    """
    schema = "d int, pos int, entry int, n long, sums array<string>"

    def total(pdf: pd.DataFrame) -> list:
        return [str(sum(map(int, c))) for c in zip(*pdf.sums)]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict[tuple, list] = {}
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                have = acc.setdefault((r.d, r.pos, r.entry), [0, [0] * len(r.sums)])
                have[0] += r.n
                have[1] = [a + int(b) for a, b in zip(have[1], r.sums)]
        yield pd.DataFrame([(*k, n, list(map(str, s))) for k, (n, s) in acc.items()], columns=["d", "pos", "entry", "n", "sums"])

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*map(int, key), int(pdf.n.sum()), total(pdf))], columns=["d", "pos", "entry", "n", "sums"])

    rows = resident.select("d", "pos", "entry", "n", "sums").mapInPandas(partial, schema).groupBy("d", "pos", "entry").applyInPandas(add, schema).collect()
    new = {d: [b.copy() for b in parts] for d, parts in books.items()}
    for r in rows:  # PARTS * ENTRIES of them for each length of vectors
        new[r["d"]][r["pos"]][r["entry"]] = [int(s) // r["n"] for s in r["sums"]]
    return new


def first_books(data: DataFrame) -> Books:
    """Codebooks of the ENTRIES smallest vec_ids of each length, their parts in ascending order; of a repeated id the least vector."""
    rows = data.where("vec_id is not null").groupBy(F.size("q").alias("d"), "vec_id").agg(F.min("q").alias("q"))
    few = rows.groupBy("d").agg(F.min("vec_id").alias("low")).select("d").collect()
    out = {}
    for d in (r["d"] for r in few):
        top = [[int(x) for x in r["q"]] for r in rows.where(F.col("d") == d).orderBy("vec_id").limit(ENTRIES).collect()]
        cut = bounds(d)
        out[d] = [np.array([v[cut[p] : cut[p + 1]] for v in top], dtype=object).reshape(len(top), cut[p + 1] - cut[p]) for p in range(PARTS)]
    return out


def train(data: DataFrame, rounds: int = ROUNDS) -> Books:
    """Codebooks after Lloyd rounds over all rows of `data` (vec_id, q, row).

    Parts live in rows of their owners (position, entry, salt): packed members, their sums and their count. A
    round adds up what owners hold, moves the entries, and looks through each owner's members where
    they are; the ones that changed entry are put in rows of their own, and the next shuffle carries
    only these. An entry that holds most of a table is spread over salts, one for OWNER_ROWS vectors. Each
    round is a written table; a lost executor costs the tasks it ran.
    """
    spark, books = data.sparkSession, first_books(data)
    known = data.where(F.size("q").isin(list(books)))
    salts = max(1, -(-known.count() // OWNER_ROWS))
    shared = spark.sparkContext.broadcast(books)
    arrived = materialize(_first_owners(known, shared, salts))
    settled = materialize(_settled(arrived))
    release(arrived)
    resident, held = settled, [settled]
    for i in range(rounds):
        books = _updated(resident, books)
        shared.destroy()
        if i == rounds - 1:
            break
        shared = spark.sparkContext.broadcast(books)
        judged = materialize(_stay_or_move(resident, shared))
        settled = materialize(_settled(judged.where("moved")))
        release(*held)
        resident, held = judged.where("not moved").unionByName(settled), [judged, settled]
    release(*held)
    return books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components, by part, entry and position within the part."""
    return hashlib.sha256(",".join(str(int(x)) for b in books for row in b for x in row).encode()).hexdigest()


def encode(data: DataFrame, books: Books) -> DataFrame:
    """`data` with _code (two hexadecimal digits for each part), _error (squared distances summed, at most 2**63 - 1) and _books (digest)."""
    shared = data.sparkSession.sparkContext.broadcast((books, {d: digest(b) for d, b in books.items()}))

    @F.pandas_udf("code string, error long, books string")
    def coded(q: pd.Series) -> pd.DataFrame:
        known, names = shared.value
        out = pd.DataFrame({"code": [None] * len(q), "error": np.zeros(len(q), np.int64), "books": [None] * len(q)}, index=q.index)
        for d, own in q.groupby(q.map(len)):
            if d not in known:
                continue
            x, cut = np.stack(own.to_numpy()).astype(np.float64).reshape(len(own), d), bounds(d)
            found = [nearest(x[:, cut[p] : cut[p + 1]], known[d][p]) for p in range(PARTS)]
            code = np.stack([e for e, _ in found], axis=1)
            out.loc[own.index, "code"] = ["".join(f"{e:02x}" for e in row) for row in code.tolist()]
            out.loc[own.index, "error"] = np.array([min(sum(map(int, row)), (1 << 63) - 1) for row in zip(*(e for _, e in found))], np.int64)
            out.loc[own.index, "books"] = names[d]
        return out

    got = data.withColumn("_c", coded("q"))
    return got.select("*", F.col("_c.code").alias("_code"), F.col("_c.error").alias("_error"), F.col("_c.books").alias("_books")).drop("_c", "q", "row")


def compress(vectors: DataFrame, scale: int = 4096, rounds: int = ROUNDS) -> DataFrame:
    """Rows of `vectors` (vec_id, embedding, further columns) with _code, _error and _books.

    Rows with a null vector, a null component or one that is not finite are left out. Numbers are exact, also
    beyond 64 bits; an error beyond them is given as 2**63 - 1. Repeated rows count, and come out, as
    often as they occur; of a repeated vec_id the least vector can be an entry. A row without a
    vec_id takes part in training and is coded, but is never a first entry. Fewer than ENTRIES ids: as
    many entries. Vectors of each length have codebooks of their own; a length of which no row has a
    vec_id has none, and its rows' code and digest are null, their error 0. Parts are equal if
    the length can be divided by PARTS, else nearly; they may be empty. Empty table: no rows.
    """
    data = materialize(whole_numbers(vectors, scale).withColumn("row", F.monotonically_increasing_id()))
    books = train(data.select("vec_id", "q", "row"), rounds)
    return encode(data, books)
