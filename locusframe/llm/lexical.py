"""Exact ranked search for the terms of items over all documents, by geometric blocks of posting lists."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import materialize, release, without_shuffle_files
from .tokens import Words, slices

#: Bytes of the items' texts that are searched for at a time, documents of a shard of the index, and documents of a block.
QUERY_BYTES, SHARD, BLOCK = 1 << 18, 8192, 32
#: Directions onto which documents are projected to tell which are alike, and the seed that draws them.
DIRECTIONS, SEED = 16, 7
#: Documents that a first pass searches for each item's floor, about.
FIRST = 1 << 14

#: Terms are runs of digits, letters and bytes beyond ASCII; A-Z count as a-z, and 0 parts terms.
TERM_BYTES = np.arange(256, dtype=np.uint64) + np.uint64(1)
TERM_BYTES[65:91] = TERM_BYTES[97:123].copy()
for _a, _b in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    TERM_BYTES[_a : _b + 1] = 0

_FOUND = "item long, row long, has_id boolean, id long, score long"


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each range, one range after the other."""
    return np.repeat(start - np.r_[0, np.cumsum(length)[:-1]], length) + np.arange(int(length.sum()))


@dataclass
class Items:
    """Items of one part: number of each, and their distinct terms (as places in the vocabulary) with repeats, items end to end.

    `weight` is set once the documents of each term are counted.
    """

    number: np.ndarray
    hashes: np.ndarray
    first: np.ndarray
    term: np.ndarray
    repeats: np.ndarray
    weight: np.ndarray | None = None

    @staticmethod
    def of(number: np.ndarray, texts: list[bytes]) -> Items:
        w = Words(texts, TERM_BYTES)
        hashes, place = np.unique(w.hash, return_inverse=True)
        owner = np.repeat(np.arange(len(texts)), np.diff(w.first))
        pairs, repeats = np.unique(owner * max(1, len(hashes)) + place, return_counts=True)
        owner, term = np.divmod(pairs, max(1, len(hashes)))
        return Items(number, hashes, np.searchsorted(owner, np.arange(len(texts) + 1)), term, repeats)

    def weigh(self, documents: int, df: np.ndarray) -> None:
        w = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        self.weight = w[self.term] * self.repeats


def term_vectors(docs: DataFrame, hashes) -> DataFrame:
    """(row, has_id, id, n, terms, counts): each document with a term: all its terms' number, and its counts of the vocabulary's terms, packed.

    `hashes` is a broadcast of the vocabulary's sorted hashes. Rows are numbered, so equal ids, and none, stay apart.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = hashes.value
        for pdf in batches:
            texts, out = pdf.text.tolist(), []
            for a, b in slices(texts):
                w = Words(texts[a:b], TERM_BYTES)
                at = np.minimum(np.searchsorted(known, w.hash), max(0, len(known) - 1))
                hit = known[at] == w.hash if len(known) else np.zeros(len(w.hash), bool)
                owner = np.repeat(np.arange(b - a), np.diff(w.first))[hit]
                pairs, counts = np.unique(owner * max(1, len(known)) + at[hit], return_counts=True)
                owner, term = np.divmod(pairs, max(1, len(known)))
                cut = np.searchsorted(owner, np.arange(b - a + 1)).tolist()
                term, counts = term.astype(np.int32), counts.astype(np.int32)
                out += [(int(n), term[i:j].tobytes(), counts[i:j].tobytes()) for n, i, j in zip(np.diff(w.first), cut, cut[1:])]
            got = pd.DataFrame(out, columns=["n", "terms", "counts"])
            yield pd.concat([pdf[["row", "has_id", "id"]].reset_index(drop=True), got], axis=1)[lambda x: x.n > 0]

    rows = docs.where("text is not null").select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").isNotNull().alias("has_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.col("text").cast("binary").alias("text")
    )
    return rows.mapInPandas(run, "row long, has_id boolean, id long, n long, terms binary, counts binary")


def document_counts(vectors: DataFrame, terms: int) -> np.ndarray:
    """In how many documents each of the vocabulary's terms occurs; tasks count their own first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = np.zeros(terms, np.int64)
        for pdf in batches:
            acc += np.bincount(np.frombuffer(b"".join(pdf.terms), np.int32), minlength=terms)
        yield pd.DataFrame({"term": np.flatnonzero(acc), "n": acc[acc > 0]})

    out = np.zeros(terms, np.int64)
    with without_shuffle_files(vectors.sparkSession):
        rows = vectors.select("terms").mapInPandas(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    for r in rows:  # one for each term of the items at most
        out[r["term"]] = r["n"]
    return out


class Shard:
    """An index of some documents: their vectors, and each term's posting list in blocks of documents that are alike.

    `value` is a term's part of a score before its weight; `floor` a bound that a score must reach. Of a
    list, only the coordinates that items with this term ask for go into the summaries.
    """

    def __init__(self, first: np.ndarray, term: np.ndarray, value: np.ndarray, weight: np.ndarray):
        self.first, self.term, self.value = first, term, value
        order = np.argsort(term, kind="stable")
        self.owner = np.repeat(np.arange(len(first) - 1), np.diff(first))[order]
        self.terms, start = np.unique(term[order], return_index=True)
        self.cut = np.r_[start, len(term)]
        self.most = np.maximum.reduceat(value[order], start) if len(start) else np.zeros(0)
        drawn = np.random.default_rng(SEED).normal(0, 1, (len(weight), DIRECTIONS)).astype(np.float32) * weight[:, None].astype(np.float32)
        self.shape = np.add.reduceat(drawn[term] * value[:, None].astype(np.float32), first[:-1]) if len(first) > 1 else np.zeros((0, DIRECTIONS), np.float32)
        self.shape /= np.maximum(np.linalg.norm(self.shape, axis=1, keepdims=True), 1e-9)

    def blocks(self, place: int) -> tuple[np.ndarray, np.ndarray]:
        """The documents of a term's list, by block, and where blocks begin: each document goes to the likest of some of them, and large blocks are cut."""
        docs = self.owner[self.cut[place] : self.cut[place + 1]]
        if len(docs) <= BLOCK:
            return docs, np.zeros(1, np.int64)
        pivots = docs[:: BLOCK]
        near = (self.shape[docs] @ self.shape[pivots].T).argmax(1)
        order = np.argsort(near, kind="stable")
        near = near[order]
        begins = np.flatnonzero(np.r_[True, near[1:] != near[:-1]])
        begins = np.unique(np.concatenate([np.arange(a, b, 2 * BLOCK) for a, b in zip(begins, np.r_[begins[1:], len(docs)])]))
        return docs[order], begins

    def coordinates(self, docs: np.ndarray, wanted: np.ndarray, terms: int) -> np.ndarray:
        """The documents' values of the wanted terms, (documents, terms)."""
        column = np.full(terms, -1, np.int64)
        column[wanted] = np.arange(len(wanted))
        length = self.first[docs + 1] - self.first[docs]
        at = _ranges(self.first[docs], length)
        to = column[self.term[at]]
        out = np.zeros((len(docs), len(wanted)), self.value.dtype)
        row = np.repeat(np.arange(len(docs)), length)
        out[row[to >= 0], to[to >= 0]] = self.value[at][to >= 0]
        return out

    def search(self, items: Items, weight: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, document, score) of all documents that reach their item's floor, each pair once.

        A document that reaches the floor holds a term outside the longest run of an item's weakest terms
        whose greatest values together stay under it, so only lists of such terms are looked at. A block is
        skipped for an item when its summary's score, which no member exceeds, is under the floor.
        """
        place = np.searchsorted(self.terms, items.term)
        here = (place < len(self.terms)) & (self.terms[np.minimum(place, max(0, len(self.terms) - 1))] == items.term) if len(self.terms) else np.zeros(len(items.term), bool)
        ask: dict[int, list[int]] = {}
        for i in range(len(floor)):
            own = np.arange(items.first[i], items.first[i + 1])
            own = own[here[own]]
            if len(own):
                most = self.most[place[own]] * weight[own]
                order = np.argsort(most, kind="stable")
                for t in place[own[order[np.cumsum(most[order]) >= floor[i]]]].tolist():
                    ask.setdefault(t, []).append(i)
        outs = [(np.zeros(0, np.int64),) * 3]
        for t, who in ask.items():
            docs, begins = self.blocks(t)
            span = _ranges(items.first[who], items.first[np.array(who) + 1] - items.first[who])
            wanted, column = np.unique(items.term[span], return_inverse=True)
            asked = np.zeros((len(wanted), len(who)), weight.dtype)
            asked[column, np.repeat(np.arange(len(who)), items.first[np.array(who) + 1] - items.first[who])] = weight[span]
            x = self.coordinates(docs, wanted, int(max(self.terms[-1], wanted[-1])) + 1)
            alive = np.maximum.reduceat(x, begins, axis=0) @ asked >= floor[who]
            block = np.repeat(np.arange(len(begins)), np.diff(np.r_[begins, len(docs)]))
            rows = np.flatnonzero(alive.any(1)[block])
            score = x[rows] @ asked
            r, w = np.nonzero((score >= floor[who]) & alive[block[rows]])
            outs.append((np.array(who, np.int64)[w], docs[rows[r]], score[r, w].astype(np.int64)))
        item, doc, score = (np.concatenate(c) for c in zip(*outs))
        _, once = np.unique(item * max(1, len(self.first)) + doc, return_index=True)
        return item[once], doc[once], score[once]


def _search(vectors: DataFrame, shared, k: int, documents: int, terms_in_all: int) -> DataFrame:
    """Each task's best k for each item; what a shard has found raises the floors for the next one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items, floor, by_term = shared.value
        floor = floor.copy()
        # Sums of doubles are whole numbers as long as they stay below 2**53.
        kind = np.float64 if len(items.term) == 0 or float(items.weight.sum()) * 1e6 < 2.0**53 else np.int64
        weight, best = items.weight.astype(kind), pd.DataFrame({"i": [], "row": [], "has_id": [], "id": [], "score": []}).astype({"i": int, "row": int, "has_id": bool, "id": int, "score": int})
        for pdf in batches:
            pdf = pdf[pdf.terms.map(len) > 0]
            for a in range(0, len(pdf), SHARD):
                part = pdf.iloc[a : a + SHARD]
                length = (part.terms.map(len) // 4).to_numpy(np.int64)
                term, tf = (np.frombuffer(b"".join(part[c]), np.int32).astype(np.int64) for c in ("terms", "counts"))
                m = np.array([25 + 75 * n * documents // terms_in_all for n in part.n.tolist()], np.int64)
                value = (1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(m, length))
                i, doc, score = Shard(np.r_[0, np.cumsum(length)], term, value.astype(kind), by_term).search(items, weight, floor)
                new = pd.DataFrame({"i": i, **{c: part[c].to_numpy()[doc] for c in ("row", "has_id", "id")}, "score": score})
                best = pd.concat([best, new], ignore_index=True).sort_values(["i", "score", "has_id", "id", "row"], ascending=[True, False, False, True, True], ignore_index=True)
                rank = best.groupby("i").cumcount()
                last = best[rank == k - 1]
                floor[last.i.to_numpy(np.int64)] = np.maximum(floor[last.i.to_numpy(np.int64)], last.score.to_numpy(np.int64))
                best = best[rank < k]
        yield best.assign(item=items.number[best.i.to_numpy(np.int64)])[["item", "row", "has_id", "id", "score"]]

    return vectors.select("row", "has_id", "id", "n", "terms", "counts").mapInPandas(run, _FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    """Ranks within each item, the best k: first in parts of an item's rows, so that no task gets what all tasks have found."""
    order = (F.desc("score"), F.desc("has_id"), "id", "row")
    parts = found.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(64)))
    parts = parts.withColumn("rank", F.row_number().over(W.partitionBy("item", "salt").orderBy(*order))).where(F.col("rank") <= k)
    return parts.drop("salt").withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """The k documents of `docs` (doc_id, text) that score highest for each row of `items` (item_id, text).

    Items are taken QUERY_BYTES of text at a time, and all documents are read for each such part; documents
    stay where they are, as packed counts of the items' terms. A first pass over about FIRST documents,
    by hash, gives floors; the second one searches the others with them. What tasks find is k rows for an item.

    Equal scores: smaller doc_id, then those without one. Rows of one doc_id are documents each; equal rows of
    items are asked, and answered, each. A null text has no terms; an item without terms, or whose terms occur
    nowhere or score 0, gets no rows. Numbers are whole and do not overflow below 2**63. Empty tables: no
    rows. Returns item_id, rank, doc_id, score.
    """
    spark = docs.sparkSession
    asked = materialize(items.where("text is not null").select("item_id", F.monotonically_increasing_id().alias("item"), F.col("text").cast("binary").alias("text")))
    parts = -(-(asked.agg(F.sum(F.length("text").cast("long")).alias("b")).first()["b"] or 0) // QUERY_BYTES)
    found = None
    for p in range(parts):
        own = asked.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == p).select("item", "text").toPandas()
        if not len(own):
            continue
        batch = Items.of(own["item"].to_numpy(np.int64), own.text.tolist())
        shared = spark.sparkContext.broadcast(batch.hashes)
        vectors = materialize(term_vectors(docs, shared))
        total = vectors.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("t")).first()
        if total["n"]:
            df = document_counts(vectors, len(batch.hashes))
            batch.weigh(total["n"], df)
            by_term = np.zeros(len(batch.hashes), np.int64)
            by_term[batch.term] = batch.weight // np.maximum(1, batch.repeats)
            floor = np.ones(len(batch.number), np.int64)
            few = F.pmod(F.xxhash64("row"), F.lit(max(1, total["n"] // FIRST))) == 0
            model = spark.sparkContext.broadcast((batch, floor, by_term))
            first = materialize(_best(_search(vectors.where(few), model, k, total["n"], total["t"]), k))
            at = first.where(F.col("rank") == k).select("item", "score").toPandas()
            place = pd.Index(batch.number).get_indexer(at["item"])
            floor[place] = np.maximum(floor[place], at.score.to_numpy(np.int64))
            model.destroy()
            model = spark.sparkContext.broadcast((batch, floor, by_term))
            rest = _search(vectors.where(~few), model, k, total["n"], total["t"])
            best = materialize(_best(first.drop("rank").unionByName(rest), k))
            model.destroy()
            release(first)
            found = best if found is None else found.unionByName(best)
        shared.destroy()
        release(vectors)
    if found is None:
        return asked.limit(0).select("item_id", F.lit(None).cast("int").alias("rank"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("score"))
    named = found.join(asked.select("item", "item_id"), "item")
    return named.select("item_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("has_id"), F.col("id")).alias("doc_id"), "score")
