"""Toxicity of documents: a learned lexicon, found by Levenshtein automata in a trie, and scores of the windows around its terms."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import held_out, materialize, release

#: Labelled documents of either label that training sees at most, equal texts once, and terms of them that it weighs.
TRAIN_DOCS, CANDIDATES = 6000, 8192
#: A stem's letters; the statistic (twice the log-likelihood ratio) and the ratio of shares that a term of the lexicon has at least.
STEM_LETTERS, LEAST_G, LEAST_RATIO = range(4, 13), 20.0, 4.0
#: Edits that a term may be away, by its least length: of whole words, and of stems, which other letters may follow.
WORD_EDITS, STEM_EDITS = ((9, 2), (5, 1), (0, 0)), ((10, 2), (7, 1), (0, 0))
#: Words on either side of a term that tell quotation from abuse.
WINDOW = 6
#: Words that report what others say, and words that address someone; fixed values.
REPORTING = frozenset("said says say called calls call wrote quote quoted quotes word words term terms means reported used insult insults slur "
                      "sagte sagt schrieb wort wörter nannte begriff zitat beleidigung dit disait écrit mot mots appelé terme cite insulte "
                      "dijo dice escribió palabra palabras llamó término cita insulto".split())  # fmt: skip
ADDRESS = frozenset("you your yours u ur du dich dir dein deine ihr euch tu toi te ton ta vous votre tú usted ustedes tus su".split())

#: A token begins and ends with a letter or digit; other signs may stand within it, those that part words may not.
TOKEN = re.compile(r"""[^\W_](?:[^\s"“”„«»()\[\]{}<>,.;:?…|/\\]*[^\W_])?""")
_QUOTES = re.compile(r'["“”„«»\n]')

EDITS = 2


def _edits(rule: tuple, n: int) -> int:
    return next(d for least, d in rule if n >= least)


def _transitions() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The universal automaton of at most EDITS edits: next state by state and which of the word's next letters are the term's; least distance, and distances, of a state.

    A state holds the distance between what was read of the term, i letters, and the word's first
    i - EDITS .. i + EDITS letters, each up to EDITS + 1, as digits of a number.
    """
    width, top = 2 * EDITS + 1, EDITS + 2
    digits = np.array(np.unravel_index(np.arange(top**width), (top,) * width)).T
    step = np.zeros((len(digits), 1 << width), np.int16)
    for bits in range(1 << width):
        new = np.zeros_like(digits)
        for o in range(width):
            best = digits[:, o] + (not bits >> o & 1)
            if o + 1 < width:
                best = np.minimum(best, digits[:, o + 1] + 1)
            if o:
                best = np.minimum(best, new[:, o - 1] + 1)
            new[:, o] = np.minimum(best, EDITS + 1)
        step[:, bits] = np.ravel_multi_index(new.T, (top,) * width)
    return step, digits.min(1), digits


_STEP, _LEAST, _DIGITS = _transitions()
_START = int(np.ravel_multi_index([min(EDITS + 1, abs(o)) if o >= 0 else EDITS + 1 for o in range(-EDITS, EDITS + 1)], (EDITS + 2,) * (2 * EDITS + 1)))


class Trie:
    """Terms, whole words and stems, in a trie that all words' automata walk at once."""

    def __init__(self, terms: list[tuple[str, bool]]):
        nodes: list[dict[str, int]] = [{}]
        self.edits = np.array([_edits(WORD_EDITS if whole else STEM_EDITS, len(t)) for t, whole in terms], np.int64)
        ends, budget = [], [0]
        for i, (term, _) in enumerate(terms):
            at = 0
            budget[0] = max(budget[0], int(self.edits[i]))
            for c in term:
                if c not in nodes[at]:
                    nodes[at][c] = len(nodes)
                    nodes.append({})
                    budget.append(0)
                at = nodes[at][c]
                budget[at] = max(budget[at], int(self.edits[i]))
            ends.append((at, i))
        self.whole = np.array([whole for _, whole in terms], bool)
        self.budget = np.array(budget)
        self.fan = np.array([len(n) for n in nodes])
        self.begin = np.r_[0, np.cumsum(self.fan)]
        self.char = np.array([ord(c) for n in nodes for c in n], np.uint32)
        self.child = np.array([x for n in nodes for x in n.values()], np.int64)
        ends.sort()
        self.end_node, self.end_term = (np.array(x, np.int64) for x in zip(*ends)) if ends else (np.zeros(0, np.int64),) * 2
        self.longest = max((len(t) for t, _ in terms), default=0)

    def match(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, term, distance) of all terms within their edits; a stem may be followed by any letters."""
        keep = self.longest + EDITS + 1
        length = np.array([min(len(w), keep) for w in words], np.int64)
        text = np.zeros((len(words), keep + 3 * EDITS), np.uint32)
        flat = np.frombuffer("".join(w[:keep] for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
        row = np.repeat(np.arange(len(words)), length)
        text[row, EDITS + np.arange(len(flat)) - np.repeat(np.r_[0, np.cumsum(length)[:-1]], length)] = flat
        word, node, state = np.arange(len(words)), np.zeros(len(words), np.int64), np.full(len(words), _START, np.int64)
        outs = [(np.zeros(0, np.int64),) * 3]
        for depth in range(self.longest + 1):
            lo, hi = np.searchsorted(self.end_node, node), np.searchsorted(self.end_node, node, "right")
            at = np.repeat(np.arange(len(node)), hi - lo)
            if len(at):
                term = self.end_term[np.concatenate([np.arange(a, b) for a, b in zip(lo[hi > lo], hi[hi > lo])])]
                far, w = _DIGITS[state[at]], word[at]
                over = length[w] - depth  # where the word ends, seen from here
                inside = np.arange(-EDITS, EDITS + 1) <= over[:, None]
                stem = np.where(inside, far, EDITS + 1).min(1)
                exact_end = np.where(np.abs(over) <= EDITS, far[np.arange(len(w)), np.clip(over + EDITS, 0, 2 * EDITS)], EDITS + 1)
                dist = np.where(self.whole[term], exact_end, stem)
                ok = dist <= self.edits[term]
                outs.append((w[ok], term[ok], dist[ok]))
            at = np.repeat(np.arange(len(node)), self.fan[node])
            if not len(at):
                break
            edge = np.arange(len(at)) - np.repeat(np.r_[0, np.cumsum(self.fan[node])[:-1]], self.fan[node]) + np.repeat(self.begin[node], self.fan[node])
            w, char = word[at], self.char[edge]
            bits = np.zeros(len(at), np.int64)
            for o in range(2 * EDITS + 1):
                bits |= (text[w, depth + o] == char).astype(np.int64) << o
            new, to = _STEP[state[at], bits].astype(np.int64), self.child[edge]
            alive = _LEAST[new] <= self.budget[to]
            word, node, state = w[alive], to[alive], new[alive]
        return tuple(np.concatenate(c) for c in zip(*outs))


@dataclass
class Model:
    """Terms with their evidence, how far misspellings are trusted, and the weights of a document's features."""

    terms: list[tuple[str, bool]]
    pos: np.ndarray
    neg: np.ndarray
    sizes: tuple[float, float]
    #: Misspelt forms seen in training: form -> documents with and without the label.
    forms: dict[str, tuple[int, int]] = field(default_factory=dict)
    #: How many different forms close to each term clean documents hold.
    clean: np.ndarray | None = None
    weights: np.ndarray | None = None
    trie: Trie | None = None

    def evidence(self, term: int, distance: int, form: str, label: int | None) -> float:
        """Logarithm of how much likelier a document with this form is to be toxic; `label`: that of a training document, whose own part is left out."""
        p, n = self.sizes
        pos, neg = float(self.pos[term]), float(self.neg[term])
        if label is not None and not distance:
            pos, neg = pos - label, neg - (1 - label)
        ratio = ((max(0.0, pos) + 0.3) / (p + 1)) / ((max(0.0, neg) + 0.3) / (n + 1))
        if distance:
            trust = min(ratio, 400.0) / (4 * distance) / (1 + self.clean[term])
            a, b = self.forms.get(form, (0, 0))
            if label is not None:
                a, b = max(0, a - label), max(0, b - (1 - label))
            ratio = trust if a + b == 0 else (a / p + trust / n) / ((b + 1) / n)
        return min(10.0, max(0.0, math.log(max(ratio, 1e-9))))


class Finder:
    """The terms of texts; what distinct words match is remembered, up to a bound."""

    def __init__(self, model: Model, remembered: int = 400_000):
        self.model, self.bound = model, remembered
        self.seen: set[str] = set()
        self.hot: dict[str, list[tuple[int, int]]] = {}

    def learn(self, words: set[str]) -> None:
        if len(self.seen) > self.bound:
            self.seen, self.hot = set(), {}
        new = sorted(words - self.seen) if words else []
        if len(self.seen) + len(new) > self.bound:  # what this batch needs again has to be found again
            self.seen, self.hot = set(), {}
            new = sorted(words)
        for a in range(0, len(new), 16384):
            part = new[a : a + 16384]
            for w, t, d in zip(*(x.tolist() for x in self.model.trie.match(part))):
                self.hot.setdefault(part[w], []).append((t, d))
        self.seen.update(new)

    def matches(self, texts: list[str]) -> Iterator[tuple[int, list[tuple[str, list[tuple[int, int]], int, list[str], bool]]]]:
        """Number of tokens of each text, and its terms: form, what it may be, place, words around it, and whether it stands in quotation marks."""
        lowered = [t.lower() for t in texts]
        tokens = [TOKEN.findall(t) for t in lowered]
        self.learn(set().union(*tokens))
        for text, own in zip(lowered, tokens):
            found = []
            if not self.hot.keys().isdisjoint(own):
                at = [m.start() for m in TOKEN.finditer(text)]
                marks = [m.start() for m in _QUOTES.finditer(text)]
                for i, form in enumerate(own):
                    if form in self.hot:
                        found.append((form, self.hot[form], i, own[max(0, i - WINDOW) : i] + own[i + 1 : i + 1 + WINDOW], _quoted(text, marks, at[i])))
            yield len(own), found


def _quoted(text: str, marks: list[int], at: int) -> bool:
    """Whether a place lies between marks of quotation of its line."""
    i = bisect_left(marks, at)
    before, after = [], []
    for j in range(i - 1, max(-1, i - 65), -1):
        if text[marks[j]] == "\n":
            break
        before.append(text[marks[j]])
    for j in range(i, min(len(marks), i + 64)):
        if text[marks[j]] == "\n":
            break
        after.append(text[marks[j]])
    if not before or not after:
        return False
    if before[0] == '"':
        return before.count('"') % 2 == 1 and '"' in after
    return (before[0] in "„“«" and after[0] in "“”»") or (before[0] == "»" and after[0] == "«")


def abuse(around: list[str], quoted: bool, hot) -> float:
    """Share of a term's evidence that counts, 0 to 1: quotation marks and words of reporting speak against abuse, address and further terms for it."""
    others = sum(w in hot for w in around)
    against = 2.5 * quoted + 1.0 * any(w in REPORTING for w in around) - 0.5 * any(w in ADDRESS for w in around) - 0.25 * min(others, 4)
    return 1 / (1 + math.exp(2 * (against - 1.5)))


def features(model: Model, finder: Finder, texts: list[str], labels: list[int] | None = None) -> np.ndarray:
    """A row for each text: 1, strongest evidence, evidence in all, different terms, length."""
    out = np.zeros((len(texts), 5))
    for k, (n, found) in enumerate(finder.matches(texts)):
        label = labels[k] if labels is not None else None
        known: dict[str, tuple[float, int]] = {}
        best: dict[int, float] = {}
        total = 0.0
        for form, may_be, _, around, quoted in found:
            if form not in known:
                known[form] = max((model.evidence(t, d, form, label), -d, -t) for t, d in may_be)[0], min((d, t) for t, d in may_be)[1]
            e, term = known[form]
            e *= abuse(around, quoted, finder.hot)
            total += e
            best[term] = max(best.get(term, 0.0), e)
        out[k] = 1, max(best.values(), default=0.0) / 4, math.log1p(total) / 2, math.log1p(sum(e > 1 for e in best.values())), math.log1p(n) / 8
    return out


def _terms(text: str) -> set[tuple[str, bool]]:
    """Words of letters of a text, and their stems."""
    words = {w for w in TOKEN.findall(text.lower()) if w.isalpha() and len(w) <= 40}
    return {(w, True) for w in words} | {(w[:k], False) for w in words for k in STEM_LETTERS if k <= len(w)}


def chosen(candidates: list[tuple[str, bool]], toxic: np.ndarray, clean_count: np.ndarray, clean: int) -> list[int]:
    """Terms that cover the toxic documents, (documents, candidates), best first; a document counts half as much for each term that it has."""
    weight, left = np.ones(len(toxic)), np.ones(len(candidates), bool)
    pos = toxic.sum(0)
    ratio = ((pos + 0.3) / (len(toxic) + 1)) / ((clean_count + 0.3) / (clean + 1))
    kind = np.array([(whole, len(t)) for t, whole in candidates])
    bonus = 1e-6 * (kind[:, 0] * 100 + kind[:, 1]) if len(kind) else np.zeros(0)
    out = []
    while left.any():
        gain = np.where(left, weight @ toxic * np.log(np.maximum(ratio, 1.0001)), -1)
        i = int((gain * (1 + bonus)).argmax())
        if gain[i] <= 0 or float(weight @ toxic[:, i]) < 1.0:
            break
        out.append(i)
        left[i] = False
        weight = np.where(toxic[:, i], weight / 2, weight)
    return out


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Weights of a ridge logistic regression, by Newton's method with halved steps."""
    w, loss = np.zeros(x.shape[1]), np.inf
    hold = np.r_[0.0, np.full(x.shape[1] - 1, ridge)]
    of = lambda w: float((weight * (np.logaddexp(0, x @ w) - y * (x @ w))).sum() + 0.5 * (hold * w * w).sum())
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + hold * w
        step = np.linalg.solve((x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(hold + 1e-6), grad)
        size = 1.0
        while size > 1e-4 and of(w - size * step) > loss:
            size /= 2
        new = of(w - size * step)
        w = w - size * step
        if loss - new < 1e-9 * abs(new):
            break
        loss = new
    return w


def sample(docs: DataFrame, labels: DataFrame, divisor: int) -> tuple[DataFrame, dict[int, int]]:
    """(text, toxic): at most TRAIN_DOCS labelled documents of either label that are not held out, by least hash of the text, equal texts once; and how many there are of each.

    A document whose labels differ has the greater one. Only ids and hashes are joined; the texts of the sample are fetched with a broadcast of its ids.
    """
    marks = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out("doc_id", divisor)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    hashes = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("h"))
    known = materialize(hashes.join(marks, "doc_id").groupBy("toxic", "h").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")))
    sizes = {r["toxic"]: (r["n"], r["k"]) for r in known.groupBy("toxic").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).collect()}
    # Least hashes: what lies under a share of the hashes holds them, with a margin.
    under = F.lit(False)
    for label, (_, k) in sizes.items():
        under = under | ((F.col("toxic") == label) & (F.pmod("h", F.lit(1 << 20)) <= int(min(1.0, 1.5 * TRAIN_DOCS / k + 0.001) * (1 << 20))))
    place = F.row_number().over(W.partitionBy("toxic").orderBy(F.pmod("h", F.lit(1 << 20)), "h"))
    ids = known.where(under).withColumn("place", place).where(F.col("place") <= TRAIN_DOCS).select("doc_id", "h", "toxic")
    mine = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    got = materialize(mine.join(F.broadcast(ids), ["doc_id", "h"]).select("text", "toxic").distinct())
    release(known)
    return got, {label: n for label, (n, _) in sizes.items()}


def learn(docs: DataFrame, labels: DataFrame, divisor: int = 4) -> Model | None:
    """Lexicon, misspelt forms and weights, from the bounded sample; None without documents of both labels."""
    spark = docs.sparkSession
    rows, sizes = sample(docs, labels, divisor)
    counts = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts.get(0) or not counts.get(1):
        release(rows)
        return None
    p, n = counts[1], counts[0]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pos, neg = Counter(), Counter()
        for pdf in batches:
            for text, y in zip(pdf.text, pdf.toxic):
                (pos if y else neg).update(_terms(text))
        yield pd.DataFrame([(*t, pos[t], neg[t]) for t in pos.keys() | neg.keys()], columns=["term", "whole", "pos", "neg"])

    terms = rows.mapInPandas(count, "term string, whole boolean, pos long, neg long").groupBy("term", "whole").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    a, b, share = F.col("pos"), F.col("neg"), p / (p + n)
    part = lambda k, e: F.when(k > 0, k * F.log(k / ((a + b) * e))).otherwise(0.0)
    terms = terms.where("pos >= 2").withColumn("g", 2 * (part(a, share) + part(b, 1 - share)))
    terms = terms.where((F.col("g") >= LEAST_G) & ((a + 0.3) / (p + 1) >= LEAST_RATIO * (b + 0.3) / (n + 1))).orderBy(F.desc("g"), "term", "whole").limit(CANDIDATES).collect()
    names = [(r["term"], r["whole"]) for r in terms]
    place = spark.sparkContext.broadcast({t: i for i, t in enumerate(names)})

    def incidence(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own = [np.array(sorted(place.value[t] for t in _terms(x) if t in place.value), np.int32).tobytes() for x in pdf.text]
            yield pd.DataFrame({"terms": own})

    packed = rows.where("toxic = 1").select("text").mapInPandas(incidence, "terms binary").collect()
    toxic = np.zeros((len(packed), len(names)), bool)
    for i, r in enumerate(packed):
        toxic[i, np.frombuffer(r["terms"], np.int32)] = True
    pick = chosen(names, toxic, np.array([r["neg"] for r in terms], float), n)
    place.destroy()
    model = Model([names[i] for i in pick], np.array([terms[i]["pos"] for i in pick], float), np.array([terms[i]["neg"] for i in pick], float), (float(p), float(n)))
    model.trie = Trie(model.terms)
    shared = spark.sparkContext.broadcast(model)

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pos, neg, term = Counter(), Counter(), {}
        finder = Finder(shared.value)
        for pdf in batches:
            for y, (_, found) in zip(pdf.toxic, finder.matches(pdf.text.tolist())):
                forms = {f: m for f, m, *_ in found if min(d for _, d in m)}
                term.update((f, sorted({t for t, _ in m})) for f, m in forms.items())
                (pos if y else neg).update(forms.keys())
        yield pd.DataFrame([(f, term[f], pos[f], neg[f]) for f in term], columns=["form", "terms", "pos", "neg"])

    forms = rows.mapInPandas(near, "form string, terms array<int>, pos long, neg long").groupBy("form").agg(F.first("terms").alias("terms"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).collect()
    shared.destroy()
    model.forms = {r["form"]: (r["pos"], r["neg"]) for r in forms}
    model.clean = np.zeros(len(model.terms))
    for r in forms:
        if r["neg"]:
            model.clean[list(r["terms"])] += 1
    shared = spark.sparkContext.broadcast(model)

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Finder(shared.value)
        for pdf in batches:
            x = features(shared.value, finder, pdf.text.tolist(), pdf.toxic.tolist())
            yield pd.DataFrame({"toxic": pdf.toxic.to_numpy(), "x": list(x)})

    got = rows.mapInPandas(measured, "toxic int, x array<double>").toPandas()
    shared.destroy()
    release(rows)
    y = got.toxic.to_numpy(np.float64)
    order = np.lexsort(np.stack(got.x.to_numpy()).T)
    of = np.where(y == 1, sizes[1] / p, sizes[0] / n)  # as many as there are of each label
    model.weights = _logistic(np.stack(got.x.to_numpy())[order], y[order], (of / of.mean())[order])
    return model


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """`docs` with _score, from 0 to 1."""
    if model is None:
        return docs.withColumn("_score", F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        finder = Finder(shared.value)
        for texts in batches:
            x = features(shared.value, finder, texts.tolist())
            yield pd.Series(1 / (1 + np.exp(-np.clip(x @ shared.value.weights, -30, 30))))

    return docs.withColumn("_score", scored(F.coalesce("text", F.lit(""))))


def toxicity(docs: DataFrame, labels: DataFrame, divisor: int = 4) -> DataFrame:
    """`docs` (doc_id, text, further columns) with _held_out and _score.

    Words and stems that mark labelled documents form a lexicon; a term is found where it is spelt right, or within its edits
    where clean documents do not spell so. Around each a window is scored: quotation counts little. A document's strongest and summed
    evidence, its different terms and its length give the score. Texts are read whole.

    Null and empty texts: the score of a text without terms. Repeated rows are scored each. Null labels, labels but 0 and 1, and labels of
    unknown documents teach nothing. No labelled documents of both kinds: 0 for all. Empty table: no rows.
    """
    return score(docs.withColumn("_held_out", held_out("doc_id", divisor)), learn(docs, labels, divisor))
