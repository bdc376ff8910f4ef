"""Sums over sites for all pairs of samples: products of indicator matrices in tasks, by segments and by tiles.

Calls become planes of bits (a few long words a site), by one aggregate that tasks start on their own
rows. A task unpacks blocks of sites and adds up matrix products. For up to TILE samples it holds one
matrix per sum and segment. Beyond, samples are cut into tiles, and a task holds the sums of one (row tile,
column tile) at a time, whatever the number of samples.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .planes import UNROLLED, _bit, n_words

#: Sites of a block, samples of a tile, bytes of sums that a task holds before it hands them on, and sites of a block that travels to a tile.
BLOCK, TILE, HELD_BYTES, SENT = 4096, 2048, 256 << 20, 512
Bits = dict[str, np.ndarray]


@dataclass(frozen=True)
class Dosages:
    """Sums over dosages 0..top: shared and equal calls, differences, their squares, and calls in one sample only."""

    top: int = 2
    names = ("shared", "equal", "absdiff", "sqdiff", "one_sided")

    @property
    def planes(self) -> dict[str, Column]:
        # "below" planes: OR-ed bits of repeated calls give the least dosage.
        return {"c": F.col("dosage").isNotNull()} | {f"b{v}": F.col("dosage") < v for v in range(1, self.top + 1)}

    def __call__(self, x: Bits, y: Bits) -> np.ndarray:
        side = lambda p: (p["c"].astype(np.float32), [(p["c"] & ~p[f"b{v}"]).astype(np.float32) for v in range(1, self.top + 1)])
        (cx, above_x), (cy, above_y) = side(x), side(y)
        shared = cx.T @ cy
        # One plane for each dosage: called, and at least v but not v + 1.
        one = lambda c, above: [lo - hi for lo, hi in zip([c, *above], [*above, np.zeros_like(c)])]
        equal = sum(a.T @ b for a, b in zip(one(cx, above_x), one(cy, above_y)))
        apart = sum((a.T @ (cy - b) + (cx - a).T @ b for a, b in zip(above_x, above_y)), np.zeros_like(shared))
        gx, gy = sum(above_x, np.zeros_like(cx)), sum(above_y, np.zeros_like(cy))
        square = (gx * gx).T @ cy + cx.T @ (gy * gy) - 2 * gx.T @ gy
        return np.stack([shared, equal, apart, square, cx.sum(0)[:, None] + cy.sum(0)[None, :] - 2 * shared])


@dataclass(frozen=True)
class Table:
    """Sums of a distance between sets of alleles: `value[u][v]` for sets u and v as bits; 0 is a missing call. Sums: shared, total."""

    value: tuple[tuple[float, ...], ...]
    names = ("shared", "total")

    @property
    def alleles(self) -> int:
        return len(self.value).bit_length() - 1

    @property
    def planes(self) -> dict[str, Column]:
        # A call that lacks an allele is missing; of repeated calls, all alleles count.
        full = F.col("a1").isNotNull() & F.col("a2").isNotNull()
        over = F.when(F.greatest("a1", "a2") >= self.alleles, F.raise_error(F.lit("an allele number beyond the table of sets")).cast("boolean"))
        return {f"p{a}": F.coalesce(over, full & ((F.col("a1") == a) | (F.col("a2") == a))) for a in range(self.alleles)}

    def __call__(self, x: Bits, y: Bits) -> np.ndarray:
        state = lambda p: sum((p[f"p{a}"].astype(np.int8) << a for a in range(self.alleles)))
        sx, sy, table = state(x), state(y), np.array(self.value)
        total = np.zeros((sx.shape[1], sy.shape[1]))
        for u in np.unique(sx[sx > 0]).tolist():
            total += (sx == u).astype(np.float64).T @ table[u][sy]
        return np.stack([(sx > 0).astype(np.float64).T @ (sy > 0).astype(np.float64), total])


def set_table(distance: Callable[[int, int, int], float], alleles: int = 4) -> Table:
    """The table of a distance given by |A|, |B| and |A and B|; 2 ** alleles sets."""
    bits = lambda x: bin(x).count("1")
    return Table(tuple(tuple(distance(bits(u), bits(v), bits(u & v)) if u and v else 0.0 for v in range(1 << alleles)) for u in range(1 << alleles)))


def bit_rows(calls: DataFrame, keys: list[str], planes: dict[str, Column], n: int) -> DataFrame:
    """One row per group of `keys` (site_id among them) with the planes' words, from long calls with sample_idx 0..n-1.

    Places outside, and null ones, are left out.
    """
    w, zero = n_words(n), F.lit(0).cast("long")
    rows = calls.where(F.col("sample_idx").between(0, n - 1)).select(*keys, F.floor(F.col("sample_idx") / 64).cast("int").alias("_w"), _bit(F.col("sample_idx") % 64).alias("_b"), *[F.coalesce(c, F.lit(False)).alias(k) for k, c in planes.items()])
    if w <= UNROLLED:
        got = rows.groupBy(*keys).agg(*[F.bit_or(F.when((F.col("_w") == i) & F.col(k), F.col("_b")).otherwise(zero)).alias(f"{k}_{i}") for k in planes for i in range(w)])
        return got.select(*keys, *[F.array(*[f"{k}_{i}" for i in range(w)]).alias(k) for k in planes])
    parts = rows.groupBy(*keys, "_w").agg(*[F.bit_or(F.when(F.col(k), F.col("_b")).otherwise(zero)).alias(k) for k in planes])
    got = parts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_w", F.struct(*planes)))).alias("_m"))
    line = lambda k: F.transform(F.sequence(F.lit(0), F.lit(w - 1)), lambda i: F.coalesce(F.try_element_at("_m", i)[k], zero))
    return got.select(*keys, *[line(k).alias(k) for k in planes])


def unpacked(pdf: pd.DataFrame, names: list[str], n: int) -> Bits:
    """Bits of the planes, sites x samples."""
    return {k: np.unpackbits(np.stack(pdf[k].to_numpy()).astype("<i8").view(np.uint8), axis=1, bitorder="little")[:, :n].astype(bool) for k in names}


def _types(df: DataFrame, by: list[str]) -> str:
    return "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in by)


def _by_segment(pdf: pd.DataFrame, by: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    if not by:
        yield (), pdf
        return
    for key, own in pdf.groupby(by, sort=False, dropna=False):
        yield key if isinstance(key, tuple) else (key,), own


def _added(parts: DataFrame, keys: list[str], sums: tuple[str, ...], kind: str) -> DataFrame:
    """Rows of arrays added up by key, first within some salts, so that no group grows with the number of tasks."""
    schema = kind + "n_sites long, " + ", ".join(f"{k} array<double>" for k in sums)

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({**{c: pdf[c].iloc[:1].to_numpy() for c in keys}, "n_sites": [int(pdf.n_sites.sum())], **{k: [np.sum(np.stack(pdf[k].to_numpy()), axis=0)] for k in sums}})

    salted = parts.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(64)))
    return salted.groupBy(*keys, "_salt").applyInPandas(lambda pdf: add(pdf), schema).groupBy(*keys).applyInPandas(add, schema)


def pair_sums(rows: DataFrame, by: list[str], kernel: Dosages | Table, n: int, tile: int | None = None) -> DataFrame:
    """(by, i, j, n_sites and the kernel's sums) of each two samples i < j, over the rows of each segment of `by`.

    `rows` comes from `bit_rows` with the kernel's planes. n_sites: rows of the segment. No rows: none.
    """
    tile = TILE if tile is None else tile
    if n > tile:
        return _tiled(rows, by, kernel, n, tile)
    sums, names, kind = kernel.names, list(kernel.planes), _types(rows, by)
    most = max(1, HELD_BYTES // (8 * len(sums) * max(1, n * n)))

    def handed(acc: dict) -> pd.DataFrame:
        outs = [pd.DataFrame({**{c: [k] * n for c, k in zip(by, key)}, "i": np.arange(n), "n_sites": seen, **{s: list(m[x]) for x, s in enumerate(sums)}}) for key, (seen, m) in acc.items()]
        return pd.concat(outs, ignore_index=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict[tuple, list] = {}
        for pdf in batches:
            for key, own in _by_segment(pdf, by):
                if key not in acc and len(acc) >= most:
                    yield handed(acc)
                    acc = {}
                have = acc.setdefault(key, [0, np.zeros((len(sums), n, n))])
                for a in range(0, len(own), BLOCK):
                    bits = unpacked(own.iloc[a : a + BLOCK], names, n)
                    have[0] += len(bits[names[0]])
                    have[1] += kernel(bits, bits)
        if acc:
            yield handed(acc)

    parts = rows.select(*by, *names).mapInPandas(run, f"{kind}i int, n_sites long, " + ", ".join(f"{k} array<double>" for k in sums))
    added = _added(parts, [*by, "i"], sums, f"{kind}i int, ")
    zipped = F.arrays_zip(F.sequence(F.lit(0), F.lit(n - 1)).alias("j"), *[F.col(k) for k in sums])
    return added.select(*by, "i", "n_sites", F.explode(F.slice(zipped, F.col("i") + 2, F.lit(n))).alias("x")).select(*by, "i", F.col("x.j").alias("j"), "n_sites", *[F.col(f"x.{k}").alias(k) for k in sums])


def _tiled(rows: DataFrame, by: list[str], kernel: Dosages | Table, n: int, tile: int) -> DataFrame:
    """`pair_sums` by a grid of tiles of samples x samples.

    Blocks of SENT sites go, packed, to each two tiles (row tile <= column tile): a block of a tile meets
    every tile once. Tasks get the blocks of several two tiles in their order, add up one after the other, and
    hand on one row of sums for each sample of the row tile, so memory is that of one tile of sums.
    """
    sums, names, kind = kernel.names, list(kernel.planes), _types(rows, by)
    cuts = [*range(0, n, tile), n]
    tiles = len(cuts) - 1

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seq = 0
        for pdf in batches:
            for key, own in _by_segment(pdf, by):
                for a in range(0, len(own), SENT):
                    bits = unpacked(own.iloc[a : a + SENT], names, n)
                    size = len(bits[names[0]])
                    cut = [np.packbits(np.stack([bits[k][:, lo:hi] for k in names])).tobytes() for lo, hi in zip(cuts, cuts[1:])]
                    seq += 1
                    for t in range(tiles):  # one row tile at a time leaves
                        yield pd.DataFrame([(*key, t, u, seq, size, cut[t], cut[u]) for u in range(t, tiles)], columns=[*by, "_row", "_col", "_seq", "_size", "_x", "_y"])

    def opened(packed: bytes, size: int, width: int) -> Bits:
        all_ = np.unpackbits(np.frombuffer(packed, np.uint8), count=len(names) * size * width).reshape(len(names), size, width).astype(bool)
        return dict(zip(names, all_))

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, seen, acc = None, 0, None

        def handed() -> pd.DataFrame:
            t, u = at[-2:]
            return pd.DataFrame({**{c: [k] * acc.shape[1] for c, k in zip(by, at)}, "i": np.arange(cuts[t], cuts[t + 1]), "_col": u, "n_sites": seen, **{s: list(acc[x]) for x, s in enumerate(sums)}})

        for pdf in batches:
            for r in pdf.itertuples(index=False, name=None):
                key, (t, u, _, size, x, y) = r[: len(by)], r[len(by) :]
                if at != (*key, t, u):
                    if at is not None:
                        yield handed()
                    at, seen, acc = (*key, t, u), 0, np.zeros((len(sums), cuts[t + 1] - cuts[t], cuts[u + 1] - cuts[u]))
                acc += kernel(opened(x, size, cuts[t + 1] - cuts[t]), opened(y, size, cuts[u + 1] - cuts[u]))
                seen += size
        if at is not None:
            yield handed()

    sent = rows.select(*by, *names).mapInPandas(send, f"{kind}_row int, _col int, _seq long, _size int, _x binary, _y binary")
    dealt = sent.withColumn("_salt", F.pmod("_seq", F.lit(8))).repartition(*by, "_row", "_col", "_salt").drop("_salt").sortWithinPartitions(*by, "_row", "_col")
    parts = dealt.mapInPandas(gather, f"{kind}i int, _col int, n_sites long, " + ", ".join(f"{k} array<double>" for k in sums))
    added = _added(parts, [*by, "i", "_col"], sums, f"{kind}i int, _col int, ")
    zipped = F.arrays_zip(F.sequence(F.lit(0), F.size(sums[0]) - 1).alias("j"), *[F.col(k) for k in sums])
    flat = added.select(*by, "i", "_col", "n_sites", F.explode(zipped).alias("x")).select(*by, "i", (F.col("_col") * tile + F.col("x.j")).cast("int").alias("j"), "n_sites", *[F.col(f"x.{k}").alias(k) for k in sums])
    return flat.where("i < j")


def locus_means(rows: DataFrame, kernel: Dosages | Table, n: int, value: Callable[[dict[str, np.ndarray], np.ndarray], np.ndarray], hot_sites: int = 100_000) -> DataFrame:
    """(i, j, total, loci): a distance within each locus, summed over the loci with data for the pair, and their number.

    `rows` has locus; `value` makes distances (loci, n, n) of the sums (each loci, n, n) and the loci's numbers of
    sites, NaN where a pair has no data. Rows of a locus meet in one task and are read in their
    order, many loci at once as stacked matrices; tasks hold sums over their loci, one matrix each. Loci of more
    than `hot_sites` sites are added up by `pair_sums` instead, each over all tasks. Null loci are left out.
    """
    names, sums = list(kernel.planes), kernel.names
    rows = rows.where("locus is not null")
    big = rows.groupBy("locus").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_sites).select("locus")
    together = max(1, (32 << 20) // (8 * max(1, n * n) * (len(sums) + 2)))

    def flush(pending: list[Bits], acc: np.ndarray) -> None:
        sizes = np.array([len(b[names[0]]) for b in pending])
        most = int(sizes.max())
        # Loci of one number of sites are stacked; short ones are filled up with missing calls.
        padded = {k: np.zeros((len(pending), most, n), bool) for k in names}
        for x, b in enumerate(pending):
            for k in names:
                padded[k][x, : sizes[x]] = b[k]
        got = stacked(kernel, padded)
        d = value(dict(zip(sums, got)), sizes[:, None, None])
        known = ~np.isnan(d)
        acc[0] += np.where(known, d, 0).sum(0)
        acc[1] += known.sum(0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc, pending, last, held = np.zeros((2, n, n)), [], object(), 0
        for pdf in batches:
            bits = unpacked(pdf, names, n)
            locus = pdf.locus.to_numpy()
            for a, b in zip(starts := np.flatnonzero(np.r_[True, locus[1:] != locus[:-1]]), np.r_[starts[1:], len(locus)]):
                part = {k: v[a:b] for k, v in bits.items()}
                if locus[a] == last:
                    pending[-1] = {k: np.concatenate([pending[-1][k], v]) for k, v in part.items()}
                else:
                    if len(pending) >= together or held > 1 << 16:
                        flush(pending, acc)
                        pending, held = [], 0
                    pending.append(part)
                    last = locus[a]
                held += b - a
        if pending:
            flush(pending, acc)
        yield pd.DataFrame({"i": np.arange(n), "n_sites": 0, "total": list(acc[0]), "loci": list(acc[1])})

    small = rows.join(big, "locus", "left_anti").select("locus", *names).repartition("locus").sortWithinPartitions("locus")
    added = _added(small.mapInPandas(run, "i int, n_sites long, total array<double>, loci array<double>"), ["i"], ("total", "loci"), "i int, ")
    zipped = F.arrays_zip(F.sequence(F.lit(0), F.lit(n - 1)).alias("j"), "total", "loci")
    got = added.select("i", F.explode(F.slice(zipped, F.col("i") + 2, F.lit(n))).alias("x")).select("i", F.col("x.j").alias("j"), F.col("x.total").alias("total"), F.col("x.loci").alias("loci"))
    if big.limit(1).count():
        @F.pandas_udf("double")
        def of_pair(n_sites: pd.Series, *parts: pd.Series) -> pd.Series:
            return pd.Series(value({k: p.to_numpy() for k, p in zip(sums, parts)}, n_sites.to_numpy()))

        hot = pair_sums(rows.join(big, "locus", "left_semi"), ["locus"], kernel, n).withColumn("total", of_pair("n_sites", *sums))
        got = got.unionByName(hot.where(~F.isnan("total") & F.col("total").isNotNull()).select("i", "j", "total", F.lit(1.0).alias("loci")))
        got = got.groupBy("i", "j").agg(F.sum("total").alias("total"), F.sum("loci").alias("loci"))
    return got.where("loci > 0").select("i", "j", "total", F.col("loci").cast("long").alias("loci"))


def stacked(kernel: Dosages | Table, bits: Bits) -> np.ndarray:
    """The kernel's sums for each of many matrices (loci, sites, samples), by stacked products: (sums, loci, n, n)."""
    t = lambda m: m.transpose(0, 2, 1)
    if isinstance(kernel, Table):
        s = sum((bits[f"p{a}"].astype(np.int8) << a for a in range(kernel.alleles)))
        table = np.array(kernel.value)
        total = sum((t((s == u).astype(np.float64)) @ table[u][s] for u in np.unique(s[s > 0]).tolist()), np.zeros((len(s), s.shape[2], s.shape[2])))
        known = (s > 0).astype(np.float64)
        return np.stack([t(known) @ known, total])
    c = bits["c"].astype(np.float64)
    g = sum((bits["c"] & ~bits[f"b{v}"]).astype(np.float64) for v in range(1, kernel.top + 1))
    shared = t(c) @ c
    square = t(g * g) @ c
    zero = np.zeros_like(shared)
    return np.stack([shared, zero, zero, square + t(square) - 2 * t(g) @ g, zero])
