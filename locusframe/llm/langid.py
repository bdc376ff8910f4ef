"""Language identification by a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import held_out

#: Labelled documents of each language that training sees at most, places in each, and bytes at each place.
TRAIN_DOCS, TRAIN_PLACES, TRAIN_BYTES = 1000, 12, 64
#: Units of each direction, size of a byte's vector.
HIDDEN, EMBED = 8, 8
#: Bytes of a piece of text, bytes on either side of it that the network reads before and after, and pieces read at a time.
SPAN, CONTEXT, LANES = 256, 32, 1024


class Network:
    """Two gated recurrent layers, one from each side, and a softmax over labels at every byte.

    It reads bytes of text across words; what comes before and after a position, as far as the
    given bytes go, forms the two states there. Weights are numpy arrays in `w`.
    """

    def __init__(self, labels: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        n, e, h = len(labels), EMBED, HIDDEN
        self.labels = labels
        make = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
        self.w = {"E": (make(256, e) * np.float32(4)), "V": make(2 * h, n), "c": np.zeros(n, np.float32)}
        for side in "fb":
            self.w |= {f"W{side}": make(e, 3 * h), f"U{side}": make(h, 3 * h), f"b{side}": np.zeros(3 * h, np.float32)}

    @staticmethod
    def _sigmoid(x: np.ndarray) -> np.ndarray:
        return 0.5 * (1 + np.tanh(0.5 * x))

    def _run(self, x: np.ndarray, mask: np.ndarray, side: str, keep: bool):
        """States of one direction, (steps, lanes, units); `keep` also returns what training needs."""
        h, (t, n) = HIDDEN, x.shape
        # Gates are 0.5 + 0.5 tanh(x / 2): the half is in their weights already.
        half = np.r_[np.full(2 * h, 0.5), np.ones(h)].astype(self.w["E"].dtype)
        table = (self.w["E"] @ self.w[f"W{side}"] + self.w[f"b{side}"]) * half
        first, last = np.ascontiguousarray(table[:, : 2 * h]), np.ascontiguousarray(table[:, 2 * h :])
        gates, new_u = self.w[f"U{side}"][:, : 2 * h] * half[: 2 * h], np.ascontiguousarray(self.w[f"U{side}"][:, 2 * h :])
        state = np.zeros((n, h), table.dtype)
        out, memo, full = np.empty((t, n, h), table.dtype), {}, mask.all(1)
        for i in range(t) if side == "f" else range(t - 1, -1, -1):
            zr = first.take(x[i], axis=0)
            zr += state @ gates
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            z, r = zr[:, :h], zr[:, h:]
            c = last.take(x[i], axis=0)
            c += (r * state) @ new_u
            np.tanh(c, out=c)
            if keep:
                memo[i] = (state, z, r, c)
            new = c - state
            new *= z
            new += state
            out[i] = state = new if full[i] else np.where(mask[i][:, None], new, state)
        return out, memo

    def log_probabilities(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Logarithm of the label probabilities of every position, (labels, steps, lanes)."""
        v = self.w["V"].T
        y = v[:, :HIDDEN] @ self._run(x, mask, "f", False)[0].reshape(-1, HIDDEN).T
        y += v[:, HIDDEN:] @ self._run(x, mask, "b", False)[0].reshape(-1, HIDDEN).T
        y += self.w["c"][:, None]
        y -= y.max(0)
        y -= np.log(np.exp(y).sum(0))
        return y.reshape(-1, *x.shape)

    def gradients(self, x: np.ndarray, mask: np.ndarray, label: np.ndarray) -> tuple[dict, float]:
        """Gradient of the mean cross entropy of all positions, by backpropagation through time."""
        h, w = HIDDEN, self.w
        runs = {s: self._run(x, mask, s, True) for s in "fb"}
        both = np.concatenate([runs[s][0] for s in "fb"], axis=2)
        y = both @ w["V"] + w["c"]
        y = np.exp(y - y.max(2, keepdims=True))
        y /= y.sum(2, keepdims=True)
        count = mask.sum()
        loss = -np.log(np.take_along_axis(y, np.broadcast_to(label[None, :, None], (*x.shape, 1)), 2)[..., 0][mask] + 1e-9).mean()
        y[:, np.arange(x.shape[1]), label] -= 1
        y *= (mask / count)[..., None].astype(np.float32)
        g = {"V": np.einsum("tnh,tnk->hk", both, y), "c": y.sum((0, 1)), "E": np.zeros_like(w["E"])}
        dboth = y @ w["V"].T
        for s, part in (("f", dboth[..., :h]), ("b", dboth[..., h:])):
            u, memo, t = w[f"U{s}"], runs[s][1], len(x)
            gu, da_all = np.zeros_like(u), np.zeros((t, x.shape[1], 3 * h), np.float32)
            carry = np.zeros((x.shape[1], h), np.float32)
            for i in range(t - 1, -1, -1) if s == "f" else range(t):
                state, z, r, c = memo[i]
                total = carry + part[i]
                d = total * mask[i][:, None]
                carry = total - d
                dc = d * z * (1 - c * c)
                drs = dc @ u[:, 2 * h :].T
                dz, dr = d * (c - state) * z * (1 - z), drs * state * r * (1 - r)
                dzr = np.concatenate([dz, dr], 1)
                gu[:, 2 * h :] += (r * state).T @ dc
                gu[:, : 2 * h] += state.T @ dzr
                carry = carry + d * (1 - z) + drs * r + dzr @ u[:, : 2 * h].T
                da_all[i] = np.concatenate([dzr, dc], 1)
            flat = da_all.reshape(-1, 3 * h)
            by_byte = np.zeros((256, 3 * h), np.float32)
            np.add.at(by_byte, x.ravel(), flat)
            g |= {f"U{s}": gu, f"b{s}": flat.sum(0), f"W{s}": w["E"].T @ by_byte}
            g["E"] += by_byte @ w[f"W{s}"].T
        return g, float(loss)

    def fit(self, pieces: list[bytes], label: np.ndarray, steps: int = 400, batch: int = 128, rate: float = 0.02, seed: int = 6) -> float:
        """Adam over random batches of pieces, as many of each label; returns the mean loss of the last steps."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(x) for k, x in self.w.items()}
        last = []
        chance = 1 / np.bincount(label)[label]
        chance /= chance.sum()
        for step in range(1, steps + 1):
            pick = rng.choice(len(pieces), batch, p=chance)
            x, mask = padded([pieces[i] for i in pick])
            g, loss = self.gradients(x, mask, label[pick])
            lr = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k in self.w:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                self.w[k] = (self.w[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
            last = [*last[-49:], loss]
        return float(np.mean(last))


def padded(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the pieces, (steps, pieces), and where they are real."""
    n = np.fromiter(map(len, pieces), np.int64, len(pieces))
    steps = int(n.max(initial=1))
    x = np.frombuffer(b"".join(p.ljust(steps, b"\0") for p in pieces), np.uint8).reshape(len(pieces), steps).T
    return x, np.arange(steps)[:, None] < n


def pool(network: Network, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Best label and its pooled probability, of each text.

    Every byte of a text gets label probabilities. Texts are read in pieces of SPAN bytes, each with
    CONTEXT bytes before and after it that only form the states; pieces lie side by side in numpy. The
    geometric mean of the positions' probabilities, made to sum to one, is the pooled probability.
    """
    pieces = [(i, a, min(a + SPAN, len(t))) for i, t in enumerate(texts) for a in range(0, len(t), SPAN)]
    pieces.sort(key=lambda p: min(p[2] + CONTEXT, len(texts[p[0]])) - max(p[1] - CONTEXT, 0))
    sums = np.zeros((len(texts), len(network.labels)))
    for k in range(0, len(pieces), LANES):
        part = pieces[k : k + LANES]
        x, mask = padded([texts[i][max(a - CONTEXT, 0) : b + CONTEXT] for i, a, b in part])
        before = np.array([min(a, CONTEXT) for _, a, _ in part])
        own = before + np.array([b - a for _, a, b in part])
        step = np.arange(len(x))[:, None]
        logs = network.log_probabilities(x, mask)
        logs *= (step >= before) & (step < own)
        np.add.at(sums, [i for i, _, _ in part], logs.sum(1, dtype=np.float64).T)
    mean = sums / np.maximum(1, np.fromiter(map(len, texts), np.int64, len(texts)))[:, None]
    p = np.exp(mean - mean.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    return p.argmax(1), p.max(1)


def portions(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Texts in order, some two million bytes at a time (a longer text alone)."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= 2 << 20:
            yield part
            part, size = [], 0
    if part:
        yield part


def places(text: bytes) -> list[bytes]:
    """TRAIN_BYTES bytes at each of some places of a text, TRAIN_PLACES at most, the same for equal texts."""
    rng = np.random.default_rng(zlib.crc32(text))
    n = min(TRAIN_PLACES, max(1, len(text) // TRAIN_BYTES))
    return [text[a : a + TRAIN_BYTES] for a in rng.integers(0, max(1, len(text) - TRAIN_BYTES), n).tolist()] if text else []


def train(labelled: DataFrame, docs: int = TRAIN_DOCS) -> Network | None:
    """A network fitted on a bounded sample of labelled rows (lang, text); None without labels.

    Every language of the rows is learned, however rare. The sample: of each language the `docs`
    different texts whose hashes are least, about, and some places of each (`places`). Rows equal in text
    and language count once. Training runs on the driver; its data grow with the number of languages only.
    """
    usable = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64("text").alias("h"))
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.approx_count_distinct("h", 0.05).alias("n")).collect()}
    if not counts:
        return None
    # Part of the range of hashes that holds a little more than `docs` of a language's texts.
    top = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, int((1 << 62) * min(1.0, 1.5 * docs / max(1, n))))])
    some = usable.where(F.pmod("h", F.lit(1 << 62)) <= top[F.col("lang")])
    rank = F.dense_rank().over(W.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 62)), "h"))
    few = some.dropDuplicates(["lang", "h"]).withColumn("rank", rank).where(F.col("rank") <= docs).select("lang", "h", F.encode("text", "utf-8").alias("text"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [(lang, h, i, x) for lang, h, t in zip(pdf.lang, pdf.h, pdf.text) for i, x in enumerate(places(t))]
            yield pd.DataFrame(found, columns=["lang", "h", "i", "piece"])

    rows = sorted((r["lang"], r["h"], r["i"], bytes(r["piece"])) for r in few.mapInPandas(cut, "lang string, h long, i int, piece binary").collect())
    if not rows:
        return None
    labels = sorted({r[0] for r in rows})
    network = Network(labels)
    network.fit([r[3] for r in rows], np.array([labels.index(r[0]) for r in rows]))
    return network


def identify(docs: DataFrame, network: Network | None = None, divisor: int = 4) -> DataFrame:
    """Documents with their predicted language: columns of `docs`, _held_out, _lang_pred, _score.

    Without a network, one is trained on the documents whose crc32(doc_id as text) mod `divisor` is
    not 2 and whose lang is known. The network labels every byte of the whole text (`pool`); the label
    with the greatest sum of log probabilities wins, and _score is its share after the geometric mean
    over positions. Very long texts are read whole, in pieces.

    Null text, empty text and text without a letter: `und`, score 0. No labelled rows: all `und`.
    Null doc_id: not held out. Repeated rows get the same answer; empty table: no rows. Columns of
    `docs` of the added names, or of the name _lang_found, are replaced or dropped.
    """
    spark = docs.sparkSession
    if network is None:
        network = train(docs.where(~held_out("doc_id", divisor)))
    out = docs.drop("_held_out", "_lang_pred", "_score").withColumn("_held_out", held_out("doc_id", divisor))
    if network is None:
        return out.withColumn("_lang_pred", F.lit("und")).withColumn("_score", F.lit(0.0))
    shared = spark.sparkContext.broadcast(network)

    @F.pandas_udf("label string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = [pool(shared.value, p) for p in portions(list(texts))]
            best, score = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0))
            yield pd.DataFrame({"label": np.array(shared.value.labels, dtype=object)[best], "score": score})

    has_letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    out = out.withColumn("_lang_found", predict(F.when(has_letter, F.encode("text", "utf-8")).otherwise(F.lit(b""))))
    return out.withColumn("_lang_pred", F.when(has_letter, F.col("_lang_found.label")).otherwise(F.lit("und"))).withColumn("_score", F.when(has_letter, F.col("_lang_found.score")).otherwise(F.lit(0.0))).drop("_lang_found")
