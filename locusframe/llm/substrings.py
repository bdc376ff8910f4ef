"""Substring dedup: windows of words that occur more than once, by super-k-mer partitioning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_map, in_map, materialize, release, small
from .tokens import Words, slices

#: Words of a window and of a minimiser.
WINDOW, MINI = 35, 8
#: Distinct strings of a bucket, on average.
BUCKET_ROWS = 4_000
#: A minimiser with more super-k-mers than this is split by a second one, whatever the input.
HOT_ROWS = 4_000
#: Bits of the map of hot minimisers.
HOT_BITS = 22
#: A key with more super-k-mers than this after that is no bucket's: its windows are counted as rows, by 128-bit hashes.
WIDE_ROWS = 16_000
#: A window in more strings than this meets them by a broadcast, so that no task holds them all.
WIDE_COPIES = 100_000


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` consecutive numbers."""
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[: len(x) - span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if span < width else x


def _minimisers(words: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of MINI words, and for each window the place of its least one (leftmost)."""
    n = len(words) - MINI + 1
    h = np.zeros(n, np.uint64)
    for j in range(MINI):
        h = h * np.uint64(0x100000001B3) + words[j : j + n]
    h = _mixed(h + np.uint64(seed))
    place = np.arange(n, dtype=np.uint64)
    least = _sliding_least((h & ~np.uint64(0xFFFFFFF)) | place, WINDOW - MINI + 1)
    return h, (least & np.uint64(0xFFFFFFF)).astype(np.int64)


def super_kmers(w: Words, hot: np.ndarray | None):
    """(key, document, first word, last word) arrays of the texts' super-k-mers; words by their number.

    A super-k-mer is a longest run of consecutive windows with the same minimiser. The windows of a
    hot minimiser (a map of hashes) are split by a second one as well; equal windows have equal keys either way.
    """
    words, total = w.hash, len(w.hash)
    if total < WINDOW:
        return (np.zeros(0, np.int64),) * 4
    doc = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    h, place = _minimisers(words, 1)
    starts = np.arange(total - WINDOW + 1)
    whole = doc[starts] == doc[starts + WINDOW - 1]
    starts, place = starts[whole], place[whole]
    if not len(starts):
        return (np.zeros(0, np.int64),) * 4
    key = _mixed(h[place] ^ np.uint64(0x2545F4914F6CDD1D))  # least hashes are small numbers; spread anew
    change = np.r_[True, (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)]
    if hot is not None:
        h2, place2 = _minimisers(words, 2)
        place2 = place2[whole]
        is_hot = in_map(hot, key)
        key = np.where(is_hot, _mixed(key ^ _mixed(h2[place2])), key)
        change[1:] |= is_hot[1:] & (place2[1:] != place2[:-1])
    at = np.flatnonzero(change)
    last = np.r_[at[1:], len(starts)] - 1
    d = doc[starts[at]]
    return key[at].view(np.int64), d, starts[at], starts[last] + WINDOW - 1


def _repeated_spans(packed: list[bytes], weight: np.ndarray) -> list[tuple[int, int, int]]:
    """(string, first word, last word) of the windows that occur twice or more, all packed strings counted.

    Windows are sorted by a 64-bit hash of their words; equal neighbours are compared word by word, by
    the words' own 64-bit hashes and lengths. Windows that touch are one span.
    """
    hashes, sizes, firsts, total = [], [], [0], 0
    for a, b in slices(packed):
        w = Words(packed[a:b], False)
        hashes.append(w.hash)
        sizes.append((w.end - w.start).astype(np.int32))
        firsts += (w.first[1:] + total).tolist()
        total += len(w.hash)
    if total < WINDOW:
        return []
    word, size, first = np.concatenate(hashes), np.concatenate(sizes), np.array(firsts)
    row = np.repeat(np.arange(len(packed)), np.diff(first))
    n = total - WINDOW + 1
    h = np.zeros(n, np.uint64)
    for j in range(WINDOW):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += word[j : j + n]
    start = np.flatnonzero(row[:n] == row[WINDOW - 1 :])
    order = start[np.argsort(h[start], kind="stable")]
    if not len(order):
        return []
    same = np.r_[False, h[order][1:] == h[order][:-1]]
    for j in range(WINDOW):
        pick = np.flatnonzero(same)
        x, y = order[pick] + j, order[pick - 1] + j
        same[pick] = (word[x] == word[y]) & (size[x] == size[y])
    group = np.cumsum(~same) - 1
    at = np.sort(order[np.bincount(group, weights=weight[row[order]])[group] >= 2])
    if not len(at):
        return []
    # Starts at most a window apart in one string belong to one span.
    cut = np.flatnonzero((row[at[1:]] != row[at[:-1]]) | (at[1:] > at[:-1] + WINDOW)) + 1
    lo, hi = at[np.r_[0, cut]], at[np.r_[cut, len(at)] - 1]
    return list(zip(row[lo].tolist(), (lo - first[row[lo]]).tolist(), (hi - first[row[hi]] + WINDOW - 1).tolist()))


def _window_hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every window of packed strings as a row: 128 bits of its words' hashes and lengths, where it starts, and how many equal strings hold it."""
    for pdf in batches:
        packed = list(pdf.packed)
        for a, b in slices(packed):
            w = Words(packed[a:b], False)
            total = len(w.hash)
            if total < WINDOW:
                continue
            row = np.repeat(np.arange(b - a), np.diff(w.first))
            n = total - WINDOW + 1
            other = _mixed(w.hash ^ (w.end - w.start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            h1, h2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            for j in range(WINDOW):
                h1 = h1 * np.uint64(0x9E3779B97F4A7C15) + w.hash[j : j + n]
                h2 = h2 * np.uint64(0xC2B2AE3D27D4EB4F) + other[j : j + n]
            at = np.flatnonzero(row[:n] == row[WINDOW - 1 :])
            i = row[at] + a
            yield pd.DataFrame({
                "key": pdf.key.to_numpy()[i], "string": pdf.string.to_numpy()[i], "n": pdf.n.to_numpy()[i], "at": (at - w.first[row[at]]).astype(np.int32),
                "h1": _mixed(h1[at]).view(np.int64), "h2": _mixed(h2[at]).view(np.int64),
            })


def _wide_spans(strings: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(key, string, a, b) of strings under keys too wide for a bucket, and the tables behind them.

    Equal windows meet as partial sums, not as rows. The starts of a super-k-mer's windows are less than a
    window apart, so those that occur twice or more make one span.
    """
    windows = materialize(strings.mapInPandas(_window_hashes, "key long, string long, n long, at int, h1 long, h2 long"))
    twice = materialize(windows.groupBy("h1", "h2").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("rows")).where("total > 1"))
    common, _ = small(twice.where(F.col("rows") > WIDE_COPIES).select("h1", "h2"))
    rest = twice.where(F.col("rows") <= WIDE_COPIES).select("h1", "h2")
    met = windows.join(common, ["h1", "h2"], "left_semi").unionByName(windows.join(common, ["h1", "h2"], "left_anti").join(rest, ["h1", "h2"], "left_semi"))
    spans = met.groupBy("key", "string").agg(F.min("at").alias("a"), (F.max("at") + (WINDOW - 1)).cast("int").alias("b"))
    return spans, [windows, twice, common]


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Texts without the words covered by a window of `WINDOW` words that also starts elsewhere.

    1. Minimisers of all super-k-mers are counted (hashes only). Equal windows have equal
       minimisers, so only super-k-mers with a repeated one can hold a repeated window; a map of
       fixed size, with false positives only, tells the tasks which. Minimisers with more than
       HOT_ROWS super-k-mers, known by another such map, are split by a second minimiser.
    2. Those super-k-mers travel as one packed string each. Equal strings are counted before they
       meet their bucket, where sorting finds the windows that occur twice or more, exactly. Under a
       key with more than WIDE_ROWS of them even so, windows are counted as rows, by 128-bit hashes.
    3. The spans go back to the documents that hold the string; the others are not shuffled.

    Null or empty text: no words. Texts shorter than a window stay. Repeated rows are documents of
    their own, and so each other's copies. Empty table: no rows. Other columns are ignored.
    Returns doc_id, text_key, n_words, n_removed, kept (the words left, joined by one space).
    """
    spark = docs.sparkSession
    # Ids go through Python as text: a batch with a null id would turn long ones to doubles.
    src = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.coalesce(F.encode("text", "utf-8"), F.lit(b"")).alias("text"))

    def count(batches):
        for pdf in batches:
            texts = list(pdf.text)
            for a, b in slices(texts):
                key, *_ = super_kmers(Words(texts[a:b], False), None)
                if len(key):
                    k, n = np.unique(key, return_counts=True)
                    yield pd.DataFrame({"key": k, "n": n})

    counts = materialize(src.select("text").mapInPandas(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1"))
    sc = spark.sparkContext
    repeated = sc.broadcast(hash_map(counts, "key"))
    hot = sc.broadcast(hash_map(counts.where(F.col("n") > HOT_ROWS), "key", HOT_BITS))

    def pack(batches):
        for pdf in batches:
            all_texts = list(pdf.text)
            for a, b in slices(all_texts):
                w = Words(all_texts[a:b], False)
                key, d, s, e = super_kmers(w, None)
                keep = in_map(repeated.value, key.view(np.uint64))
                wide = in_map(hot.value, key.view(np.uint64))
                if wide.any():
                    k2, d2, s2, e2 = super_kmers(w, hot.value)
                    # Split super-k-mers lie inside those of a hot minimiser.
                    inside = _inside(s2, s[wide], e[wide])
                    keep &= ~wide
                    key, d, s, e = (np.r_[x[keep], y[inside]] for x, y in ((key, k2), (d, d2), (s, s2), (e, e2)))
                else:
                    key, d, s, e = key[keep], d[keep], s[keep], e[keep]
                if not len(key):
                    continue
                packed = [w.blob[p:q] for p, q in zip(w.start[s].tolist(), w.end[e].tolist())]
                yield pd.DataFrame({"key": key, "packed": packed, "doc_id": pdf.doc_id.to_numpy()[a:b][d], "text_key": pdf.text_key.to_numpy()[a:b][d], "start": (s - w.first[d]).astype(np.int32)})

    found = materialize(src.mapInPandas(pack, "key long, packed binary, doc_id string, text_key long, start int").withColumn("string", F.xxhash64("packed")))
    repeated.destroy()
    hot.destroy()
    release(counts)
    wide, _ = small(found.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > WIDE_ROWS).select("key"))
    buckets = max(1, -(-found.count() // BUCKET_ROWS))
    equal = lambda rows: rows.groupBy("key", "string").agg(F.any_value("packed").alias("packed"), F.count(F.lit(1)).alias("n"))
    strings = equal(found.join(wide, "key", "left_anti"))

    def spans(pdf: pd.DataFrame) -> pd.DataFrame:
        got = np.array(_repeated_spans(list(pdf.packed), pdf.n.to_numpy(np.float64)), np.int64).reshape(-1, 3)
        i = got[:, 0]
        return pd.DataFrame({"key": pdf.key.to_numpy()[i], "string": pdf.string.to_numpy()[i], "a": got[:, 1].astype(np.int32), "b": got[:, 2].astype(np.int32)})

    spanned = strings.groupBy(F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket")).applyInPandas(spans, "key long, string long, a int, b int")
    temporary = [found, wide]
    if not wide.isEmpty():
        more, tables = _wide_spans(equal(found.join(wide, "key", "left_semi")))
        spanned, temporary = spanned.unionByName(more), temporary + tables
    cover = found.select("key", "string", "doc_id", "text_key", "start").join(spanned, ["key", "string"])
    by_doc = cover.select("doc_id", "text_key", F.struct((F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("b")).alias("b")).alias("span")).groupBy("doc_id", "text_key").agg(F.collect_set("span").alias("spans"))
    by_doc = materialize(by_doc.select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k"), F.transform("spans", lambda x: x["a"]).alias("a"), F.transform("spans", lambda x: x["b"]).alias("b")))
    release(*temporary)
    # Documents without a span, by a map of fixed size, are cut where they lie; only the others meet their spans.
    spanned_docs = sc.broadcast(hash_map(by_doc, "_k", HOT_BITS + 3))

    def rows(pdf: pd.DataFrame, a, b) -> pd.DataFrame:
        n, gone, kept = [], [], []
        for text, x, y in zip(pdf.text, a, b):
            t = text.split()
            n.append(len(t))
            if x is not None and len(x):
                off = np.zeros(len(t) + 1, np.int32)
                np.add.at(off, np.asarray(x), 1)
                np.add.at(off, np.asarray(y) + 1, -1)
                stay = np.cumsum(off)[:-1] == 0
                t = [w for w, z in zip(t, stay.tolist()) if z]
            gone.append(n[-1] - len(t))
            kept.append(b" ".join(t))
        return pd.DataFrame({"doc_id": pdf.doc_id, "text_key": pdf.text_key, "n_words": n, "n_removed": gone, "kept": kept})

    def has_span(pdf: pd.DataFrame) -> np.ndarray:
        return in_map(spanned_docs.value, pdf.text_key.to_numpy(np.int64).view(np.uint64))

    def whole(batches):
        for pdf in batches:
            pdf = pdf[~has_span(pdf)]
            none = [None] * len(pdf)
            yield rows(pdf, none, none)

    def met(batches):
        for pdf in batches:
            yield pdf[has_span(pdf)]

    def cut(batches):
        for pdf in batches:
            yield rows(pdf, pdf.a, pdf.b)

    schema = "doc_id string, text_key long, n_words long, n_removed long, kept binary"
    left = src.mapInPandas(met, src.schema).join(by_doc, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_key") == F.col("_k")), "left").select("doc_id", "text_key", "text", "a", "b")
    out = src.mapInPandas(whole, schema).unionByName(left.mapInPandas(cut, schema))
    return out.withColumns({"doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType), "kept": F.decode("kept", "utf-8")})


def _inside(starts: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whether each first word starts a window of one of the sorted ranges."""
    if not len(first):
        return np.zeros(len(starts), bool)
    at = np.searchsorted(first, starts, side="right") - 1
    return (at >= 0) & (starts <= last[np.maximum(at, 0)] - WINDOW + 1)
