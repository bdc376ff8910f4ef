"""Jaccard join of documents on word n-grams by token-combination prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_map, in_map, materialize
from .components import compared, components, split_buckets, star_pairs
from .sketches import may_link, sketch, sketched_pairs
from .tokens import Words, mixed as _mixed, slices

#: Words of a shingle; two sets link when OF * common >= PART * union.
SHINGLE, PART, OF = 5, 75, 100
#: Token classes whose counts tell rare shingles from frequent ones: a table of fixed size.
CLASS_BITS, SLICES = 20, 64
#: Documents above the noise of its class that make a shingle frequent.
FREQUENT = 48
_C = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def shingle_sets(texts: list[bytes | None]) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each text's shingles."""
    texts = [t or b"" for t in texts]
    for a, b in slices(texts):
        w = Words(texts[a:b], True)
        n = len(w.hash) - SHINGLE + 1
        if n > 0:
            h = w.hash[:n] * _C[0]
            for j in range(1, SHINGLE):
                h = h + w.hash[j : n + j] * _C[j] + (h >> np.uint64(37))
            h = _mixed(h)
        for p, q in zip(w.first.tolist(), w.first[1:].tolist()):
            if q - p >= SHINGLE:
                yield np.unique(h[p : q - SHINGLE + 1])
            elif q == p:
                yield np.zeros(0, np.uint64)
            else:
                short = np.full(1, q - p, np.uint64)
                for j in range(p, q):
                    short = short * _C[j - p] + w.hash[j : j + 1]
                yield _mixed(short + np.uint64(q - p))


def _cls(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - CLASS_BITS)).astype(np.int64)


def _tier(n: int) -> int:
    """Number of the size range (powers of OF / PART) of a set."""
    return int(np.floor(np.log(n) / np.log(OF / PART) + 1e-9))


def _tier_classes(tier: int) -> int:
    """Token classes of a tier; of one more common tokens, two share a class."""
    return max(1, int((OF / PART) ** tier / 8))


def _keys(h: np.ndarray, load: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Index keys of a set, whether each is in the shorter (indexed) prefix, and the set's rank.

    Tokens in order of their class's count, rare ones first. Common tokens of a linked pair number
    6/7 of the smaller set and 3/4 of the larger one at least, so the first of them lies in a prefix
    of both. If it is rare, its single key meets. If not, all common tokens are frequent; prefixes
    longer by k - 1 share k of them, and among k - 1 token classes two fall in one class: their
    combination is a key. Classes and k belong to the smaller set's tier of size; the larger set is
    of the same tier or the next one.
    """
    n = len(h)
    count = load[_cls(h)]
    order = np.lexsort((h, count))
    h, count = h[order], count[order]
    need_small, need_large = -(-2 * PART * n // (OF + PART)), -(-PART * n // OF)
    rank = int(min(65535, 2048 * np.log2(1 + count).mean()))
    rare = int(np.searchsorted(count, bound, side="right"))
    single = h[: min(rare, n - need_large + 1)]
    keys, small = [_mixed(single + np.uint64(0xA5))], [np.arange(len(single)) < n - need_small + 1]
    for tier in (_tier(n), _tier(n) - 1):
        if tier < 0 or n - rare < 2:
            continue
        g = _tier_classes(tier)
        k = g + 1
        at = np.arange(rare, min(n, n - need_large + k))
        if len(at) < 2:
            continue
        cls = (_mixed(h[at] + np.uint64(0x77)) % np.uint64(g)).astype(np.int64)
        by = np.argsort(cls, kind="stable")
        at, cls = at[by], cls[by]
        gap = 1
        while gap < len(at):
            pair = np.flatnonzero(cls[gap:] == cls[:-gap])
            if not len(pair):
                break
            a, b = at[pair], at[pair + gap]
            keys.append(_mixed(h[a] * _C[1] + h[b] * _C[2] + np.uint64(tier * 2 + 1)))
            small.append((b < n - need_small + k) if tier == _tier(n) else np.zeros(len(pair), bool))
            gap += 1
    return np.concatenate(keys), np.concatenate(small), rank


def _may_link(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) that the sizes and parity sketches of their sets do not rule out."""
    a, b = (nodes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")) for c in "ab")

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.loc[may_link(pdf.na, list(pdf.sa), pdf.nb, list(pdf.sb), PART, OF), ["a", "b"]]

    return pairs.join(a, "a").join(b, "b").select("a", "b", "na", "sa", "nb", "sb").mapInPandas(keep, "a long, b long")


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose sets link, by exact counts of common tokens (64-bit hashes)."""
    a = sets.select(F.col("node").alias("a"), F.col("set").alias("sa"))
    b = sets.select(F.col("node").alias("b"), F.col("set").alias("sb"))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = []
            for x, y in zip(pdf.sa, pdf.sb):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(OF * common >= PART * (len(x) + len(y) - common))
            yield pdf.loc[ok, ["a", "b"]]

    return pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb").mapInPandas(verify, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Components of documents linked by the Jaccard similarity of their word shingles.

    `docs`: doc_id (integer) and text. Lower-cased words; a set of the distinct shingles of
    `SHINGLE` words, or the whole sequence if there are fewer. Documents of equal sets are one node,
    named by a 64-bit hash of the set. Prefixes of tokens, and combinations of frequent ones, are
    the index (`_keys`). Members of a bucket are first compared with one pivot, the member of the
    most common shingles; what that joins needs no further comparison. Then tasks compare the members
    of each bucket that lie in different components by parity sketches, which prove of most pairs that
    their sets differ by too much; the other pairs are verified, the likeliest of each two components
    first and then all between components still apart, so no link between components is lost.
    Texts are read where they lie, not shuffled: maps of fixed size tell the tasks which keys
    several nodes have, and which documents' sets are to be compared.

    Null text, empty text or no words: empty set, linked with nothing. Null doc_id: n_shingles is
    given, component_id is null. Repeated rows come out as often; they link with each other under
    one id. Empty table: no rows. Other columns are ignored.
    Returns doc_id, n_shingles, component_id.
    """
    spark = docs.sparkSession
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode("text", "utf-8").alias("text"))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        load = np.zeros(1 << CLASS_BITS, np.int64)
        for pdf in batches:
            n, node, parity = [], [], []
            waiting: list[np.ndarray] = []
            for h in shingle_sets(list(pdf.text)):
                n.append(len(h))
                node.append(xxhash.xxh3_64_intdigest(h.tobytes()))
                parity.append(sketch(h))
                waiting.append(_cls(h))
                if len(waiting) == 500:
                    load += np.bincount(np.concatenate(waiting), minlength=len(load))
                    waiting = []
            if waiting:
                load += np.bincount(np.concatenate(waiting), minlength=len(load))
            yield pd.DataFrame({"doc_id": pdf.id, "n": n, "node": np.array(node, np.uint64).view(np.int64), "sketch": parity, "slice": -1, "load": None})
        for i, part in enumerate(np.split(load, SLICES)):
            if part.any():
                yield pd.DataFrame({"doc_id": [None], "n": [0], "node": [0], "sketch": [None], "slice": [i], "load": [part.astype("<i4").tobytes()]})

    # Ids go through Python as text: a batch with a null id would turn long ones to doubles.
    measured = src.select(F.col("doc_id").cast("string").alias("id"), "text").mapInPandas(measure, "doc_id string, n long, node long, sketch binary, slice int, load binary")
    measured = materialize(measured.withColumn("doc_id", F.col("doc_id").cast("long")))

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(x, "<i4").astype(np.int64) for x in pdf.load], axis=0)
        return pd.DataFrame({"slice": [pdf.slice.iat[0]], "load": [np.minimum(total, 2**31 - 1).astype("<i4").tobytes()]})

    # Added up in two steps, so that no group grows with the number of tasks.
    parts = measured.where("slice >= 0").select("slice", "load", F.pmod(F.monotonically_increasing_id(), F.lit(256)).alias("salt"))
    slices_ = parts.groupBy("slice", "salt").applyInPandas(add, "slice int, load binary").groupBy("slice").applyInPandas(add, "slice int, load binary")
    load = np.zeros((SLICES, (1 << CLASS_BITS) // SLICES), np.int32)
    for r in slices_.collect():
        load[r["slice"]] = np.frombuffer(r["load"], "<i4")
    load = load.ravel()
    # What a class holds besides a token's own documents is about the median load, give or take its root.
    noise = float(np.median(load))
    bound = FREQUENT + noise + 6 * np.sqrt(noise)
    shared_load = spark.sparkContext.broadcast(load)

    sizes = measured.where("slice < 0").select("doc_id", "n", "node")
    usable = measured.where("slice < 0 and n > 0 and doc_id is not null")
    nodes = materialize(usable.groupBy("node").agg(F.min("doc_id").alias("least"), F.any_value("n").alias("n"), F.any_value("sketch").alias("sketch")))

    def keyed(pdf: pd.DataFrame, done: set) -> Iterator[tuple[np.ndarray, int, int, np.ndarray]]:
        """Keys of each new set of a batch; copies of a set that this task has seen are skipped."""
        for h in shingle_sets(list(pdf.text)):
            node = int(np.uint64(xxhash.xxh3_64_intdigest(h.tobytes())).view(np.int64))
            if not len(h) or node in done:
                continue
            if len(done) > 1_000_000:
                done.clear()
            done.add(node)
            key, small, rank = _keys(h, shared_load.value, bound)
            # Rank, size and whether the key lies in the indexed prefix, in one number.
            yield key, node, rank, (np.int64(rank) << 40) | (np.int64(len(h)) << 1) | small.astype(np.int64)

    def keys_only(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done: set = set()
        for pdf in batches:
            out = [(k.view(np.int64), np.full(len(k), node)) for k, node, _, _ in keyed(pdf, done)]
            for a in range(0, len(out), 2000):
                yield pd.DataFrame(dict(zip(("key", "node"), map(np.concatenate, zip(*out[a : a + 2000])))))

    live = src.where("doc_id is not null")
    # Keys that one node alone has are the great majority: they end here.
    several = live.mapInPandas(keys_only, "key long, node long").groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo != hi").select("key")
    common = spark.sparkContext.broadcast(hash_map(several, "key"))

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done: set = set()
        for pdf in batches:
            out = []
            for key, node, _, meta in keyed(pdf, done):
                keep = in_map(common.value, key)
                if keep.any():
                    out.append((key[keep].view(np.int64), np.full(int(keep.sum()), node), meta[keep]))
            for a in range(0, len(out), 2000):
                yield pd.DataFrame(dict(zip(("key", "node", "meta"), map(np.concatenate, zip(*out[a : a + 2000])))))

    rows = materialize(live.mapInPandas(index, "key long, node long, meta long").distinct().withColumn("rank", F.shiftright("meta", 40)))

    size = lambda c: F.shiftright(F.col(c).bitwiseAND(F.lit((1 << 40) - 1)), 1)
    least, most = F.least(size("x_meta"), size("y_meta")), F.greatest(size("x_meta"), size("y_meta"))
    for shared in (shared_load, common):
        shared.destroy()
    pairs = materialize(_may_link(star_pairs(rows, OF * least >= PART * most), nodes))
    first = materialize(_linked(pairs, _sets(src, nodes, pairs)))
    links, known = first, pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    # The likeliest pair of each two components of a bucket, then all pairs of those still apart.
    for best in (True, False):
        placed = split_buckets(rows.select("key", "node"), components(links))
        found = compared(placed, nodes.select("node", "n", "sketch"), lambda pdf, bounds, best=best: sketched_pairs(pdf, bounds, PART, OF, best))
        found = materialize(found.join(known, ["a", "b"], "left_anti"))
        links = materialize(links.union(_linked(found, _sets(src, nodes, found))))
        known = known.union(found)
    labels = components(links)

    placed = nodes.select("node", "least").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    named = placed.groupBy("comp").agg(F.min("least").alias("component_id"))
    groups = placed.select("node", "comp").join(named, "comp").select(F.col("node").alias("_n"), "component_id")
    out = sizes.join(groups, F.col("node") == F.col("_n"), "left")
    linked = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), linked).alias("component_id"))


def _sets(src: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Packed sets of the nodes that pairs name, each from the document of the node's least id."""
    named = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    ids = nodes.join(named, "node", "left_semi").select(F.xxhash64("least").alias("h"))
    wanted = src.sparkSession.sparkContext.broadcast(hash_map(ids, "h"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf[in_map(wanted.value, pdf.h.to_numpy(np.int64).view(np.uint64))]
            sets = [h for h in shingle_sets(list(pdf.text))]
            rows = [(int(np.uint64(xxhash.xxh3_64_intdigest(h.tobytes())).view(np.int64)), h.tobytes()) for h in sets if len(h)]
            yield pd.DataFrame(rows, columns=["node", "set"]).astype({"node": "int64"})

    found = src.where("doc_id is not null").withColumn("h", F.xxhash64("doc_id")).mapInPandas(pack, "node long, set binary")
    return materialize(found.dropDuplicates(["node"]))
