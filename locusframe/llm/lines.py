"""Line dedup: near-equal lines by MinHash, banding, exact Jaccard and union-find."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_map, materialize, release, repeated_map
from .components import compared, components, in_blocks, split_buckets
from .tokens import mixed

#: Characters of a shingle.
CHARS = 5
#: Bands of ROWS MinHash values each: at a similarity of 0.75 a pair of lines shares a band with
#: probability 1 - (1 - 0.75**5)**19 = 0.994, at 0.8 with 0.999, at 0.85 with 0.9999. Lines of one
#: language share a tenth of such short shingles by chance; five values keep those out of buckets.
BANDS, ROWS = 19, 5
SIMILARITY = 0.75
#: Characters that numpy holds at a time, and members of a bucket whose pairs are listed.
SLICE, LISTED = 1 << 19, 32
_CHAR = np.random.default_rng(41).integers(1, 2**63, CHARS).astype(np.uint64) | np.uint64(1)
_ODD = np.random.default_rng(42).integers(0, 2**32, BANDS * ROWS).astype(np.uint32) | np.uint32(1)
_GAP = "\0" * (CHARS - 1)


def shingles(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the CHARS characters at every place of each line, one line after another, and how many each has.

    A shorter line has one shingle, all of it.
    """
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    code = np.frombuffer((_GAP.join(lines) + _GAP).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(code) - CHARS + 1
    h = np.zeros(max(n, 0), np.uint64)
    for j in range(CHARS):
        h += (code[j : n + j].astype(np.uint64) + np.uint64(1)) * _CHAR[j]
    count = np.maximum(1, size - CHARS + 1)
    first = np.cumsum(size + CHARS - 1) - (size + CHARS - 1)
    at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
    return mixed(h[at]), count


def slices(lines: list[str]) -> Iterator[list[str]]:
    """Lines in order, about SLICE characters at a time (a longer line alone)."""
    part, size = [], 0
    for x in lines:
        part.append(x)
        size += len(x)
        if size >= SLICE:
            yield part
            part, size = [], 0
    if part:
        yield part


def signatures(lines: list[str]) -> np.ndarray:
    """BANDS * ROWS MinHash values of each line: the least product, modulo 2**32, with each odd number."""
    h, count = shingles(lines)
    h = (h >> np.uint64(32)).astype(np.uint32)
    first = np.cumsum(count) - count
    return np.stack([np.minimum.reduceat(h * odd, first) for odd in _ODD], axis=1)


def band_keys(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """BANDS keys of each line, the hash of ROWS MinHash values and the band's number; and four bits of each value."""
    out, short = [np.zeros((0, BANDS), np.uint64)], [np.zeros((0, BANDS * ROWS), np.uint8)]
    for part in slices(lines):
        values = signatures(part)
        short.append((mixed(values.astype(np.uint64)) >> np.uint64(60)).astype(np.uint8))
        m = values.reshape(-1, BANDS, ROWS).astype(np.uint64)
        key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), m.shape[:2])
        for i in range(ROWS):
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + m[:, :, i])
        out.append(key)
    return np.concatenate(out), np.concatenate(short)


def packed(short: np.ndarray) -> np.ndarray:
    """Rows of four-bit numbers, two to a byte."""
    even = np.pad(short, ((0, 0), (0, short.shape[1] % 2)))
    return even[:, ::2] << 4 | even[:, 1::2]


def unpacked(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1)
    return np.stack([x >> 4, x & 15], axis=2).reshape(len(raw), -1)[:, : BANDS * ROWS]


def promising(pdf: pd.DataFrame, bounds: np.ndarray, similarity: float) -> pd.DataFrame:
    """The members (key, node) of buckets that agree with another in enough of the signature, in four bits of each value.

    At the least similarity that links, J, values agree with probability J + (1 - J) / 16; a pair is left
    out if it lies five deviations below the mean: one of three million such pairs is lost.
    """
    values = BANDS * ROWS
    mean = similarity + (1 - similarity) / 16
    least = values * mean - 5 * np.sqrt(values * mean * (1 - mean))
    short, keep, sizes = unpacked(list(pdf.sig)), np.zeros(len(pdf), bool), np.diff(bounds)
    for m in range(2, LISTED + 1):
        lo = bounds[:-1][sizes == m]
        i, j = np.triu_indices(m, 1)
        for part in np.array_split(lo, max(1, len(lo) * len(i) // 50_000)):
            x, y = (part[:, None] + i).ravel(), (part[:, None] + j).ravel()
            near = (short[x] == short[y]).sum(1) >= least
            keep[x[near]] = keep[y[near]] = True
    for lo, hi in zip(bounds[:-1][sizes > LISTED].tolist(), bounds[1:][sizes > LISTED].tolist()):
        for i in range(lo, hi - 1):
            near = (short[i + 1 : hi] == short[i]).sum(1) >= least
            if near.any():
                keep[i] = True
                keep[i + 1 : hi] |= near
    return pdf.loc[keep, ["key", "node"]]


class _Sets:
    """Sets of shingles of distinct lines: tokens are numbers, equal ones for equal 64-bit hashes."""

    def __init__(self, lines: list[str]):
        found = [shingles(p) for p in slices(lines)]
        h = np.concatenate([x for x, _ in found])
        owner = np.repeat(np.arange(len(lines)), np.concatenate([c for _, c in found]))
        distinct, token = np.unique(h, return_inverse=True)
        both = np.sort((owner << 32) | token)
        both = both[np.r_[True, both[1:] != both[:-1]]]
        self.owner, self.token = both >> 32, both & 0xFFFFFFFF
        self.size = np.bincount(self.owner, minlength=len(lines))
        self.first = np.r_[0, np.cumsum(self.size)]
        place = (distinct[self.token] & np.uint64(1023)).astype(np.int64)
        odd = np.bincount(self.owner * 1024 + place, minlength=1024 * len(lines)) & 1
        self.parity = np.packbits(odd.astype(np.uint8)).view(np.uint64).reshape(-1, 16)

    def of(self, i: int) -> np.ndarray:
        return self.token[self.first[i] : self.first[i + 1]]

    def bits(self, members: np.ndarray) -> np.ndarray:
        """Rows of bits of the members' tokens that two of them have, at least."""
        at = np.concatenate([np.arange(self.first[i], self.first[i + 1]) for i in members.tolist()])
        row = np.repeat(np.arange(len(members)), self.size[members])
        _, token, count = np.unique(self.token[at], return_inverse=True, return_counts=True)
        place = np.cumsum(count > 1) - 1
        keep = count[token] > 1
        row, place = row[keep], place[token[keep]]
        wide = int(place.max(initial=0)) // 64 + 1
        out = np.zeros(len(members) * wide, np.uint64)
        np.bitwise_or.at(out, row * wide + (place >> 6), np.uint64(1) << (place & 63).astype(np.uint64))
        return out.reshape(len(members), wide)


def line_links(pdf: pd.DataFrame, bounds: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one bucket whose lines are similar, as many as join all that are (columns node, line).

    Lines already joined, in whatever bucket of these rows, are not compared again. Small buckets list
    their pairs, and parity sketches (`sketches.sketch`, here of 1024 places) rule most out; large ones
    count common tokens on rows of bits.
    """
    code, nodes = pd.factorize(pdf.node)
    row = np.zeros(len(nodes), np.int64)
    row[code[::-1]] = np.arange(len(code))[::-1]
    sets = _Sets([pdf.line.iat[i] for i in row])
    top = list(range(len(nodes)))
    out: list[tuple[int, int]] = []

    def find(i: int) -> int:
        while top[i] != i:
            top[i] = i = top[top[i]]
        return i

    near = lambda x, y, common: common * (1 + similarity) >= similarity * (x + y) - 1e-9
    sizes = np.diff(bounds)
    listed = [np.zeros((0, 2), np.int64)]
    for m in range(2, LISTED + 1):
        lo = bounds[:-1][sizes == m]
        if len(lo):
            i, j = np.triu_indices(m, 1)
            listed.append(np.stack([code[(lo[:, None] + i).ravel()], code[(lo[:, None] + j).ravel()]], axis=1))
    pairs = np.unique(np.sort(np.concatenate(listed), axis=1), axis=0)
    x, y = sets.size[pairs[:, 0]], sets.size[pairs[:, 1]]
    pairs = pairs[np.minimum(x, y) >= similarity * np.maximum(x, y) - 1e-9]
    kept = []
    for p in np.array_split(pairs, max(1, len(pairs) // 100_000)):
        differ = np.bitwise_count(sets.parity[p[:, 0]] ^ sets.parity[p[:, 1]]).sum(1, dtype=np.int64)
        kept.append(p[(1 + similarity) * differ <= (1 - similarity) * (sets.size[p[:, 0]] + sets.size[p[:, 1]]) + 1e-9])
    for i, j in np.concatenate(kept).tolist():
        p, q = find(i), find(j)
        if p != q and near(sets.size[i], sets.size[j], len(np.intersect1d(sets.of(i), sets.of(j), assume_unique=True))):
            top[q] = p
            out.append((row[i], row[j]))
    for lo, hi in zip(bounds[:-1][sizes > LISTED].tolist(), bounds[1:][sizes > LISTED].tolist()):
        members = code[lo:hi]
        bits, roots = sets.bits(members), np.array([find(i) for i in members.tolist()])
        for k, i in enumerate(members.tolist()):
            rest = np.flatnonzero(roots[k + 1 :] != roots[k]) + k + 1
            if len(rest):
                common = np.bitwise_count(bits[rest] & bits[k]).sum(1, dtype=np.int64)
                js = rest[near(sets.size[i], sets.size[members[rest]], common)]
                others, first = np.unique(roots[js], return_index=True)
                for q, j in zip(others.tolist(), js[first].tolist()):
                    top[q] = int(roots[k])
                    out.append((row[i], row[members[j]]))
                roots[np.isin(roots, others)] = roots[k]
    found = np.array(out, np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


def dedup_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Documents without the lines that an earlier document or line has in equal or near-equal form.

    `docs` has doc_id and text; other columns, whatever their names, pass through (but for _n_removed
    and _n_kept, which are added: lines removed and lines left). Lines end at a line feed. Equal lines
    are grouped first, by a 64-bit hash. Distinct lines get MinHash signatures of their shingles of
    `CHARS` characters; bands put them in buckets; there the signatures tell which lines can be near
    another (`promising`), and of these the exact Jaccard similarity of the sets (64-bit hashes)
    decides, in tasks that hold a bounded block of a bucket; linked lines form components. Of each
    component the first line stays: that of the least (doc_id, place).

    Blank lines, ends of paragraphs, always stay. Lines under `CHARS` characters are near only where
    they are equal. Null text stays null, empty text empty. Null doc_id sorts first. Documents equal
    in doc_id and text count as one and keep the same lines. Very long lines are compared whole.
    Empty table: no rows.
    """
    columns = [c for c in docs.columns if c not in ("_n_removed", "_n_kept")]
    src = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")).select("row", F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"))
    src = src.withColumn("key", F.xxhash64("text"))
    lines = src.where(F.col("text").isNotNull()).select("doc_id", "key", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.where(F.col("line").rlike(r"\S")).withColumn("node", F.xxhash64("line"))
    distinct = materialize(lines.groupBy("node").agg(F.min(F.struct("doc_id", "key", "pos")).alias("first"), F.count(F.lit(1)).alias("n"), F.any_value("line").alias("line")))

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys, short = band_keys(list(pdf.line))
            yield pd.DataFrame({"node": pdf.node, "keys": [k.tobytes() for k in keys], "sig": [x.tobytes() for x in packed(short)]})

    signed = materialize(distinct.select("node", "line").mapInPandas(sign, "node long, keys binary, sig binary"))
    # Keys that one line alone has are the great majority: they end here.
    shared = docs.sparkSession.sparkContext.broadcast(repeated_map(signed, "keys", BANDS * signed.count()))

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys = np.frombuffer(b"".join(pdf["keys"]), np.uint64).reshape(-1, BANDS)
            i, j = np.nonzero(in_map(shared.value, keys.ravel()).reshape(keys.shape))
            yield pd.DataFrame({"key": keys[i, j].view(np.int64), "node": pdf.node.to_numpy()[i], "sig": pdf.sig.to_numpy()[i]})

    placed = split_buckets(signed.mapInPandas(index, "key long, node long, sig binary"), None)
    shared.destroy()
    release(signed)
    # Most lines of a bucket are there by chance; the others meet with their texts.
    near = split_buckets(in_blocks(placed, None, lambda pdf, bounds: promising(pdf, bounds, similarity), "key long, node long"), None)
    release(placed)
    links = materialize(compared(near, distinct.select("node", "line"), lambda pdf, bounds: line_links(pdf, bounds, similarity)))
    release(near)
    labels = components(links)

    named = distinct.select("node", "first", "n").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    grouped = named.groupBy("comp").agg(F.min("first").alias("kept"), F.sum("n").alias("all")).where(F.col("all") > 1).select("comp", "kept")
    repeated = materialize(named.select("node", "comp").join(grouped, "comp").select("node", "kept"))
    release(distinct, links)
    gone = lines.select("node", "doc_id", "key", "pos").join(repeated, "node").where(~F.struct("doc_id", "key", "pos").eqNullSafe(F.col("kept")))
    by_doc = materialize(gone.groupBy("doc_id", "key").agg(F.collect_set("pos").alias("gone")).select(F.col("doc_id").alias("d"), F.col("key").alias("k"), "gone"))
    release(repeated)
    out = src.join(by_doc, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left")
    left = F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains("gone", i))
    removed = F.coalesce(F.size("gone"), F.lit(0))
    text = F.when(F.col("gone").isNotNull(), F.array_join(left, "\n")).otherwise(F.col("text"))
    total = F.coalesce(F.size(F.split("text", "\n")), F.lit(0))
    # In a step of its own: a name inside the lambda must not meet a user's column of that name.
    out = out.select("row", text.alias("left"), removed.alias("removed"), (total - removed).alias("kept"))
    kept = [F.col("left").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in columns]
    return out.select(*kept, F.col("removed").alias("_n_removed"), F.col("kept").alias("_n_kept"))
