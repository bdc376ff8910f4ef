"""Language-model scores by prediction by partial matching, over a trie spread by context."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, materialize, total_bytes

#: Bytes of the longest context; contexts of two bytes and more lie in the shard of their last two.
ORDER = 5
#: Bytes of text that one task scores at a time, and positions of them that numpy holds at a time.
CHUNK_BYTES, SLICE = 8 << 20, 1 << 20
#: Bytes that no UTF-8 text holds: before the first symbol, and the end of a text.
PAD, END = b"\xfe", b"\xff"
#: Discount of the counts; what it frees, for each distinct symbol, is the escape (method D).
DISCOUNT = 0.5
KIND_GRAM, KIND_WORD, KIND_PAIR, KIND_STAT = 0, 1, 2, 3
PARTS = "kind int, bucket int, chunk int, body binary, counts binary"


def _tokens(text: bytes | None) -> list[bytes]:
    """Words, A-Z in lower case: bytes.split() splits at the same ASCII white space."""
    return text.lower().split() if text else []


def _bodies(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as symbols, each after ORDER pads and before an end; and the length of each."""
    rows = [PAD * ORDER + (b" ".join(t) + b" " if t else b"") + END for t in texts]
    return np.frombuffer(b"".join(rows), np.uint8), np.fromiter(map(len, rows), np.int64, len(rows))


def _grams(symbols: np.ndarray, lengths: np.ndarray):
    """Slices of (gram, document) for every symbol that is not a pad; a gram is context and symbol."""
    doc = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    real = symbols != PAD[0]
    for a in range(ORDER, len(symbols), SLICE):
        b = min(a + SLICE, len(symbols))
        keep = real[a:b]
        gram = symbols[a - ORDER : b - ORDER].astype(np.int64)
        for j in range(1, ORDER + 1):
            gram <<= 8
            gram |= symbols[a - ORDER + j : b - ORDER + j]
        yield gram[keep], doc[a:b][keep]


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[at], np.add.reduceat(counts[order], at)


def _packed(numbers: np.ndarray, rising: bool = False) -> bytes:
    """Whole numbers as bytes: differences, if they rise, in the least type that holds them, deflated."""
    if rising:
        numbers = np.diff(numbers, prepend=0)
    top = int(numbers.max(initial=0))
    kind = next(i for i, bits in enumerate((8, 16, 32, 63)) if top < 1 << bits)
    return bytes([kind]) + zlib.compress(numbers.astype(f"<u{1 << kind}").tobytes(), 1)


def _unpacked(raw: bytes, rising: bool = False) -> np.ndarray:
    numbers = np.frombuffer(zlib.decompress(raw[1:]), f"<u{1 << raw[0]}").astype(np.int64)
    return np.cumsum(numbers) if rising else numbers


def _shard(gram: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of a gram by the last two bytes of its context."""
    return ((((gram >> 8) & 0xFFFF) * 40503 + 977) % 65521 % buckets).astype(np.int32)


def _chunk_parts(chunk: int, texts: list[bytes | None], train: np.ndarray, buckets: int) -> pd.DataFrame:
    """What a chunk tells each shard: its distinct grams and words, with their counts in training texts."""
    rows = []
    toks = [_tokens(t) for t in texts]
    known, other = Counter(), set()
    for t, is_train in zip(toks, train):
        known.update(t) if is_train else other.update(t)
    words = [*known, *(w for w in other if w not in known)]
    counts = np.fromiter((known[w] for w in words), np.int64, len(words))
    shard = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
    order = np.argsort(shard, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1) if len(words) else []:
        rows.append((KIND_WORD, int(shard[part[0]]), chunk, zlib.compress(b" ".join([words[i] for i in part]), 1), _packed(counts[part])))
    rows.append((KIND_STAT, 0, chunk, b"", _packed(np.array([sum(len(t) + 1 for t, x in zip(toks, train) if x), int(train.sum())], np.int64))))
    del known, other, words

    symbols, lengths = _bodies(toks)
    del toks
    keys, sums = [], []
    for gram, doc in _grams(symbols, lengths):
        codes, distinct = pd.factorize(gram)
        keys.append(distinct)
        sums.append(np.bincount(codes[train[doc]], minlength=len(distinct)).astype(np.int64))
    key, n = _summed(np.concatenate(keys), np.concatenate(sums)) if keys else (np.zeros(0, np.int64),) * 2
    shard = _shard(key, buckets)
    order = np.argsort(shard, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1) if len(key) else []:
        rows.append((KIND_GRAM, int(shard[part[0]]), chunk, _packed(key[part], True), _packed(n[part])))
    pair, m = _summed(key & 0xFFFF, n)
    rows.append((KIND_PAIR, 0, chunk, _packed(pair, True), _packed(m)))
    return pd.DataFrame(rows, columns=["kind", "bucket", "chunk", "body", "counts"])


def _look(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return np.where(keys[at] == wanted, values[at], 0)


def log_probabilities(wanted: np.ndarray, key: np.ndarray, count: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """log10 probability of each wanted gram's last symbol after its context.

    `key` and `count`: the grams of training with the same last two context bytes. `pairs`: counts
    of all (byte, next byte), 256 x 256. From the longest context that training has seen: a symbol
    seen there gets (count - d) / total; else the escape, d * distinct / total, leads to the context
    without its first byte. There the symbols of the longer context are excluded: all of them were
    seen here too, so their number and their counts are a sum kept with each node. After the empty
    context, the symbols that remain of 256 are equally likely.
    """
    out = np.zeros(len(wanted))
    open_ = np.ones(len(wanted), bool)
    gone_n, gone_d = np.zeros(len(wanted), np.int64), np.zeros(len(wanted), np.int64)
    seen = key[count > 0], count[count > 0]
    levels = {}
    for k in range(ORDER, 1, -1):
        mask = (1 << (8 * (k + 1))) - 1
        levels[k] = _summed(seen[0] & mask, seen[1])
    zero = pairs.sum(0)
    full_pairs = (np.arange(65536, dtype=np.int64), pairs.ravel())
    for k in range(ORDER, -1, -1):
        gram = wanted & ((1 << (8 * (k + 1))) - 1)
        if k >= 2:
            keys, n = levels[k]
            ctx = keys >> 8
            at = np.flatnonzero(np.r_[True, ctx[1:] != ctx[:-1]]) if len(keys) else np.zeros(0, np.int64)
            nodes = ctx[at]
            below = _look(*(levels[k - 1] if k > 2 else full_pairs), keys & ((1 << (8 * k)) - 1))
            add = lambda x: np.add.reduceat(x, at) if len(at) else np.zeros(0, np.int64)
            c, total = _look(keys, n, gram), _look(nodes, add(n), gram >> 8)
            distinct, drop_n = _look(nodes, add(np.ones(len(keys), np.int64)), gram >> 8), _look(nodes, add(below), gram >> 8)
        elif k == 1:
            c, total = pairs.ravel()[gram], pairs.sum(1)[gram >> 8]
            distinct, drop_n = (pairs > 0).sum(1)[gram >> 8], ((pairs > 0) @ zero)[gram >> 8]
        else:
            c, total = zero[gram], np.full(len(gram), zero.sum())
            distinct, drop_n = np.full(len(gram), (zero > 0).sum()), np.zeros(len(gram), np.int64)
        here = open_ & (total > 0)
        left, kinds = total - gone_n, distinct - gone_d
        hit = here & (c > 0)
        out[hit] += np.log10((c[hit] - DISCOUNT) / left[hit])
        miss = here & (c == 0) & (kinds > 0)
        out[miss] += np.log10(DISCOUNT * kinds[miss] / left[miss])
        open_ &= ~hit
        gone_n, gone_d = np.where(here, drop_n, gone_n), np.where(here, distinct, gone_d)
    out[open_] -= np.log10(np.maximum(1, 256 - gone_d[open_]))
    return out


def _answer(pdf: pd.DataFrame, pairs: np.ndarray, chunks: int) -> pd.DataFrame:
    """A shard's answers to each chunk: of its grams the log10 probability, of its words the count.

    Each chunk also gets the number of the shard's distinct words in training texts.
    """
    rows = []
    if pdf.kind.iat[0] == KIND_GRAM:
        keys = [_unpacked(x, True) for x in pdf.body]
        key, count = _summed(np.concatenate(keys), np.concatenate([_unpacked(x) for x in pdf.counts]))
        values = log_probabilities(key, key, count, pairs).astype(np.float32)
        for chunk, body, k in zip(pdf.chunk, pdf.body, keys):
            rows.append((int(chunk), KIND_GRAM, body, zlib.compress(values[np.searchsorted(key, k)].tobytes(), 1), 0))
    else:
        total: dict[bytes, int] = {}
        for body, counts in zip(pdf.body, pdf.counts):
            for w, n in zip(zlib.decompress(body).split(b" "), _unpacked(counts).tolist()):
                total[w] = total.get(w, 0) + n
        seen = sum(1 for n in total.values() if n)
        answered = dict(zip(pdf.chunk, pdf.body))
        for chunk in range(chunks):
            body = answered.get(chunk)
            ws = zlib.decompress(body).split(b" ") if body is not None else []
            rows.append((chunk, KIND_WORD, body, _packed(np.fromiter(map(total.__getitem__, ws), np.int64, len(ws))), seen))
    return pd.DataFrame(rows, columns=["chunk", "kind", "body", "values", "seen"])


def _score(docs: pd.DataFrame, answers: pd.DataFrame, tokens: int, ends: int) -> pd.DataFrame:
    """Sums of a chunk's documents: tokens, known tokens, log10(count + 1), log10 probability."""
    count: dict[bytes, int] = {}
    keys, values = [], []
    for kind, body, v in zip(answers.kind, answers.body, answers["values"]):
        if kind == KIND_GRAM:
            keys.append(_unpacked(body, True))
            values.append(np.frombuffer(zlib.decompress(v), np.float32))
        elif body is not None:
            count.update(zip(zlib.decompress(body).split(b" "), _unpacked(v).tolist()))
    toks = [_tokens(t) for t in docs.text]
    n_known, base = np.zeros(len(toks), np.int64), np.zeros(len(toks))
    for i, t in enumerate(toks):
        c = np.fromiter(map(count.__getitem__, t), np.int64, len(t))
        n_known[i] = np.count_nonzero(c) + (ends > 0)
        base[i] = np.log10(c + 1.0).sum() + np.log10(ends + 1.0)
    n_tokens = np.fromiter((len(t) + 1 for t in toks), np.int64, len(toks))
    symbols, lengths = _bodies(toks)
    del toks, count
    key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
    order = np.argsort(key)
    key, value = key[order], (np.concatenate(values) if values else np.zeros(0, np.float32))[order].astype(np.float64)
    score = np.zeros(len(lengths))
    for gram, doc in _grams(symbols, lengths):
        codes, distinct = pd.factorize(gram)
        score += np.bincount(doc, weights=value[np.searchsorted(key, distinct)][codes], minlength=len(lengths))
    base -= n_tokens * np.log10(tokens + int(answers.seen.sum()) + (ends > 0) + 1.0)
    return pd.DataFrame({"doc_id": docs.doc_id, "held_out": docs.held_out, "n_tokens": n_tokens, "n_known": n_known, "train_tokens": tokens, "base_score": base, "score": score})


def score_documents(docs: DataFrame, divisor: int = 7, remainder: int = 2) -> DataFrame:
    """log10 probability of each text under a model of the texts that are not held out.

    The model is a byte-context trie of order `ORDER` with escapes by method D and symbol exclusion
    (`log_probabilities`), over lower-cased words, each followed by a space, and an end. Documents
    whose crc32(doc_id as text) mod `divisor` is `remainder` teach it nothing; a null doc_id is not
    held out. All training text counts, whole.

    Documents are dealt to chunks of about `CHUNK_BYTES` by a hash. A chunk sends its distinct grams
    and words, with their training counts, to shards (grams by the last two bytes of the context, so
    that a context and its suffixes meet); a shard adds up the counts and answers each chunk. Only
    the table of byte pairs, 65536 numbers at most, passes through the driver.

    Null or empty text: one token, the end. Repeated rows are scored, and learned from, as often as
    they come; rows equal in id and text share a chunk, so a long run of them is one group. A text longer
    than a chunk is one chunk. Empty table: no rows. Other columns are ignored. Returns doc_id, held_out, n_tokens,
    n_known, train_tokens, base_score, score.
    """
    rows, size = total_bytes(docs, "text")
    chunks = max(1, -(-(size + 16 * rows) // CHUNK_BYTES))
    buckets = max(4, min(4096, -(-chunks // 2)))
    # Ids go through Python as text: a batch with a null id would turn long ones to doubles.
    src = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce(F.encode("text", "utf-8"), F.lit(b"")).alias("text"), held_out("doc_id", divisor, remainder).alias("held_out"))
    src = src.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int"))
    src = src.repartition(chunks, "chunk")

    def tell(key, pdf: pd.DataFrame) -> pd.DataFrame:
        return _chunk_parts(int(key[0]), list(pdf.text), ~pdf.held_out.to_numpy(bool), buckets)

    parts = materialize(src.groupBy("chunk").applyInPandas(tell, PARTS))

    def unpacked(batches):
        for pdf in batches:
            for body, counts in zip(pdf.body, pdf.counts):
                yield pd.DataFrame({"pair": _unpacked(body, True), "n": _unpacked(counts)})

    def stats(batches):
        for pdf in batches:
            x = [_unpacked(c) for c in pdf.counts]
            yield pd.DataFrame({"tokens": [int(sum(v[0] for v in x))], "docs": [int(sum(v[1] for v in x))]})

    pairs = np.zeros(65536, np.int64)
    for r in parts.where(F.col("kind") == KIND_PAIR).select("body", "counts").mapInPandas(unpacked, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        pairs[r["pair"]] = r["n"]
    st = parts.where(F.col("kind") == KIND_STAT).select("counts").mapInPandas(stats, "tokens long, docs long").agg(F.sum("tokens").alias("t"), F.sum("docs").alias("d")).first()
    train_tokens, ends = st["t"] or 0, st["d"] or 0
    table = docs.sparkSession.sparkContext.broadcast(pairs.reshape(256, 256))

    answers = (
        parts.where(F.col("kind") <= KIND_WORD).repartition(2 * buckets, "kind", "bucket").groupBy("kind", "bucket")
        .applyInPandas(lambda pdf: _answer(pdf, table.value, chunks), "chunk int, kind int, body binary, values binary, seen long")
    )
    scored = src.groupBy("chunk").cogroup(answers.repartition(chunks, "chunk").groupBy("chunk")).applyInPandas(
        lambda d, a: _score(d, a, train_tokens, ends),
        "doc_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
    return scored.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
