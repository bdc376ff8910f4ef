"""The operators against brute force on small tables with nulls, ties, repeats and odd texts."""

import hashlib
import math
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from locusframe.llm import components as graph
from locusframe.llm import common, decontaminate, langid, licenses, lines, mixing, ngram_join, ppm, queries, sketches, substrings, topk
from locusframe.llm.components import components
from locusframe.llm.tokens import Words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h int"


def vocabulary(n, seed):
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzé"), rng.integers(2, 9))) for _ in range(n)]


def corpus():
    """Texts with copies, near copies, a shared passage, repeats within a text, nulls and ties."""
    rng = np.random.default_rng(11)
    words = vocabulary(300, 1)
    make = lambda n: [str(w) for w in rng.choice(words, n)]
    passage, base = make(60), make(120)
    out = [None, "", "   \n\t ", "One", "one", "a b c d", "A B C D", "x" * 300, " ".join(base), " ".join(base), "  ".join(base).upper()]
    for k in (1, 2, 4, 30):
        near = list(base)
        for p in rng.choice(120, k, replace=False):
            near[p] = "changed" + str(p)
        out.append("\n".join(" ".join(near[i : i + 30]) for i in range(0, 120, 30)))
    out += [" ".join([*make(15), *passage, *make(15)]) for _ in range(5)]
    loop = make(12)
    out += [" ".join(loop * 9), " ".join(loop[3:] + loop * 5), " ".join(make(4000))]
    out += [" ".join(make(int(n))) for n in rng.integers(1, 90, 25)]
    rows = [(i, t, None if i % 7 == 0 else "xy"[i % 2], None if i % 5 == 0 else "src" + "ab"[i % 2], None, 1) for i, t in enumerate(out)]
    return [*rows, rows[8], (None, out[8], None, None, None, None), (None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def toks(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text)) if text else []


def test_word_hashes():
    texts = [b"ab  c\tAB", b"", b"\nab", "é x y".encode()]
    w = Words(texts, True)
    assert [w.blob[a:b] for a, b in zip(w.start, w.end)] == [x for t in texts for x in t.split()]
    assert w.first.tolist() == [0, 3, 3, 4, 6]
    assert w.hash[0] == w.hash[2] == w.hash[3] and len(set(w.hash.tolist())) == 4
    assert Words(texts, False).hash[2] != w.hash[0]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(100, 101), (5, 5), (None, 3)], "a long, b long")
    got = {r["node"]: r["comp"] for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(21)}, 100: 100, 101: 100}
    assert components(edges.where("false")).count() == 0


def test_ngram_join(docs):
    data = corpus()
    sets = []
    for r in data:
        w = toks(r[1])
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    group = {r[0]: r[0] for r in data if r[0] is not None}

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, j in combinations(range(len(data)), 2):
        a, b = data[i][0], data[j][0]
        if a is None or b is None or not sets[i] or not sets[j]:
            continue
        if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            p, q = sorted((top(a), top(b)))
            group[q] = p
    got = rows_of(ngram_join.near_duplicates(docs))
    want = [(r[0], len(s), None if r[0] is None else top(r[0])) for r, s in zip(data, sets)]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=key) == sorted(want, key=key)
    assert ngram_join.near_duplicates(docs.where("false")).count() == 0


def test_frequent_shingles_meet_in_combinations():
    """With all shingles frequent, every linked pair still shares a key in the indexed prefix."""
    rng = np.random.default_rng(2)
    load = np.full(1 << ngram_join.CLASS_BITS, 1000, np.int32)
    for n in (3, 4, 7, 12, 40, 150, 900):
        for _ in range(40):
            pool = rng.integers(1, 2**63, 2 * n).astype(np.uint64)
            lose, add = rng.integers(0, n // 7 + 1), rng.integers(0, n // 7 + 1)
            a, b = pool[:n], pool[lose : n + add]
            common, union = n - lose, n + add
            if 100 * common < 75 * union or set(a.tolist()) == set(b.tolist()):
                continue
            small, large = sorted((np.unique(a), np.unique(b)), key=len)
            ks, flag, _ = ngram_join._keys(small, load, 48)
            kl, _, _ = ngram_join._keys(large, load, 48)
            assert set(ks[flag].tolist()) & set(kl.tolist()) or len(small) == len(large) and set(ngram_join._keys(large, load, 48)[0][ngram_join._keys(large, load, 48)[1]].tolist()) & set(ks.tolist())


def removed(texts):
    seen = Counter(tuple(w[i : i + 35]) for w in texts for i in range(len(w) - 34))
    out = []
    for w in texts:
        gone = {p for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for p in range(i, i + 35)}
        out.append([x for p, x in enumerate(w) if p not in gone])
    return out


@pytest.mark.parametrize("hot, wide, copies", [(substrings.HOT_ROWS, substrings.WIDE_ROWS, substrings.WIDE_COPIES), (2, substrings.WIDE_ROWS, 1), (2, 1, substrings.WIDE_COPIES), (2, 2, 2), (10**6, 0, 1)])
def test_substring_dedup(docs, hot, wide, copies, monkeypatch):
    for name, value in (("HOT_ROWS", hot), ("WIDE_ROWS", wide), ("WIDE_COPIES", copies)):
        monkeypatch.setattr(substrings, name, value)
    data = corpus()
    texts = [WORD.findall(r[1] or "") for r in data]
    kept = removed(texts)
    want = Counter((r[0], len(t), len(t) - len(k), " ".join(k)) for r, t, k in zip(data, texts, kept))
    got = rows_of(substrings.remove_repeats(docs))
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got) == want
    assert sum(r["n_removed"] for r in got) > 0
    assert substrings.remove_repeats(docs.where("false")).count() == 0


def test_split_super_kmers_cover_the_same_windows():
    rng = np.random.default_rng(8)
    w = Words([" ".join(map(str, rng.integers(0, 30, 900))).encode() for _ in range(3)], False)
    windows = lambda x: sorted(i for s, e in zip(x[2].tolist(), x[3].tolist()) for i in range(s, e - 33))
    plain = substrings.super_kmers(w, None)
    hot = np.zeros(1 << 16, np.int64)  # a map of 22 bits
    for i in (np.unique(plain[0])[::2].view(np.uint64) >> np.uint64(42)).tolist():
        hot[i >> 6] |= np.uint64(1 << (i & 63)).view(np.int64)
    split = substrings.super_kmers(w, hot)
    assert windows(plain) == windows(split) and len(split[0]) > len(plain[0])


def test_decontamination(spark):
    data = corpus()
    long = data[18][1].split()
    data += [(900, "\x00".join(long[3:30]) + "\x7f\x01zz", None, None, None, 1), (901, "Ünder_" + "-".join(long[4:30]).upper(), None, None, None, 1)]
    docs = spark.createDataFrame(data, SCHEMA).repartition(3)
    items = [("i2", " ".join(long[2:40])), ("i10", "a b c"), ("i1", data[3][1]), ("i3", None), (None, "a b"), ("i4", "..."), ("i5", data[22][1][40:300]), ("i2", " ".join(long[2:40]))]
    bench = spark.createDataFrame(items, "item_id string, text string")
    rx = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: rx.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t)) if t else []
    wins = {(n, tuple(w[i : i + n])): set() for k, t in items if k for w in [low(t)] if w for n in [min(13, len(w))] for i in range(len(w) - n + 1)}
    for k, t in items:
        if k and low(t):
            w, n = low(t), min(13, len(low(t)))
            for i in range(len(w) - n + 1):
                wins[n, tuple(w[i : i + n])].add(k)
    want = []
    for r in data:
        w, hit, own = low(r[1]), set(), set()
        for n in {n for n, _ in wins}:
            for i in range(len(w) - n + 1):
                if got := wins.get((n, tuple(w[i : i + n]))):
                    hit |= set(range(i, i + n))
                    own |= got
        want.append((r[0], len(w), len(hit), ",".join(sorted(own))))
    found = decontaminate.contaminated_words(docs, bench).withColumn("n_hit", decontaminate.n_hit())
    got = [(r["doc_id"], r["n_words"], r["n_hit"], ",".join(r["items"] or [])) for r in found.collect()]
    assert Counter(got) == Counter(want) and sum(x[2] for x in want) > 30
    assert decontaminate.contaminated_words(docs, bench.where("false")).where("hits is not null").count() == 0
    assert decontaminate.contaminated_words(docs.where("false"), bench).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(0, 0.1, 64)]) for i in range(150)]
    rows += [(151, rows[3][1]), (160, rows[20][1]), (152, None), (153, [float("nan")] * 64), (154, [None] + [0.1] * 63), (None, [0.1] * 64), (155, [float("inf")] * 64)]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "vec_id long, embedding array<double>, rank int").repartition(3)
    ok = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = set()
    for q, v in ok:
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, u)), i) for i, u in ok if i != q)[:20]
            want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    assert {tuple(r) for r in topk.top_k(df).collect()} == want
    assert topk.top_k(df.where("false")).count() == 0
    assert topk.top_k(df.where("vec_id < 5")).count() == 4


def test_top_k_with_repeated_ids_and_other_lengths(spark, monkeypatch):
    """Repeated ids: a query for each different vector; equal rows are one query and candidates each. Large numbers are exact."""
    monkeypatch.setattr(topk, "QUERY_BYTES", 30)
    monkeypatch.setattr(topk, "DATA_BLOCK", 3)
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (20, [0.0, 1.0]), (1, [2.0, 1.0]), (1, [2.0, 1.0]), (2, [1.0, 3.0]), (3, [5.0]), (40, [7.0]), (60, [3e7, 1.0]), (4, [4e7, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, k=3).collect())
    want = []
    for q, v in sorted(set((i, tuple(x)) for i, x in rows if i % 20 == 0)):
        best = sorted((-sum(int(64 * a) * int(64 * b) for a, b in zip(v, u)), i) for i, u in rows if i != q and len(u) == len(v))[:3]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want) and max(r[3] for r in got) == 64 * 64 * (3 * 4 * 10**14 + 5)


def test_branch_and_bound_with_ties():
    v = np.array([[1.0, 0]] * 50 + [[0.0, 1]] * 5)
    o, i, s = topk.search_block(np.array([7]), np.array([[2.0, 0]]), np.array([-np.inf]), np.arange(55), v, 3, 1)
    assert i.tolist() == [0, 1, 2] and s.tolist() == [2, 2, 2] and set(o.tolist()) == {0}
    o, i, s = topk.search_block(np.array([7]), np.array([[2.0, 0]]), np.array([2.0]), np.arange(55), v, 3, 1)
    assert i.tolist() == [0, 1, 2]
    assert len(topk.search_block(np.array([7]), np.array([[2.0, 0]]), np.array([3.0]), np.arange(55), v, 3, 1)[0]) == 0


def plain_mix(rows, weighed=True):
    """Targets, and copies by walking each source's Pareto ranking: rows of (doc_id, text, source)."""
    size, docs = Counter(), []
    for doc_id, text, source in rows:
        n = len(WORD.findall(text or ""))
        size[source] += n
        u = (int(hashlib.md5(f"17:{'' if doc_id is None else doc_id}:{text or ''}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        docs.append((doc_id, text, source, n, u))
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(order)}
    total, capped = 1.5 * sum(size.values()), set()
    while True:
        left = total - sum(2 * size[s] for s in capped)
        free = [s for s in order if s not in capped]
        target = {s: 2.0 * size[s] if s in capped else left * weight[s] / sum(weight[x] for x in free) for s in order}
        over = {s for s in free if target[s] > 2 * size[s]}
        if not over:
            break
        capped |= over
    copies = {}
    for s in order:
        own = [d for d in docs if d[2] == s]
        whole = math.floor(min(2.0, target[s] / size[s]) + 1e-9) if size[s] else 0
        due = max(0, math.floor(target[s] - whole * size[s] + 1e-6))
        mass = sum(math.floor(math.sqrt(d[3]) * 1024) * d[3] for d in own)
        places = {}
        for d in own:
            copies[d[:3]] = whole
            if d[3] and due:
                p = min(1 - 1e-9, max(1e-9, due / mass * math.floor(math.sqrt(d[3]) * 1024)))
                odds = d[4] / (1 - d[4]) / (p / (1 - p)) if weighed else d[4] / (1 - d[4])
                places.setdefault((odds, d[:3]), []).append(d[3])
        most, rounds = due, 0
        for (_, d), n in sorted(places.items(), key=lambda x: x[0][0]):
            if n[0] > most or rounds == 4:
                continue
            if sum(n) > due:
                most, rounds = due, rounds + 1
            else:
                due -= sum(n)
                copies[d] = min(2, whole + 1)
    return size, target, copies


def test_mixing(docs):
    got = rows_of(mixing.mix(docs))
    again = rows_of(mixing.mix(docs.repartition(5)))
    data = [(r[0], r[1], r[3]) for r in corpus()]
    size, target, copies = plain_mix(data)
    assert Counter((r["doc_id"], r["_copies"]) for r in got) == Counter((r["doc_id"], r["_copies"]) for r in again)
    assert Counter((r["doc_id"], r["text"], r["source"], r["_copies"]) for r in got) == Counter((*d, copies[d]) for d in data)
    for r in got:
        assert r["_source_size"] == size[r["source"]] and r["_target"] == pytest.approx(target[r["source"]]) and 0 <= r["_copies"] <= 2
    assert mixing.mix(docs.where("false")).count() == 0


def sized_rows():
    rng = np.random.default_rng(2)
    return [(i, "w " * int(n), f"s{min(i % 9, 4)}") for i, n in enumerate(rng.lognormal(4, 1, 1500))]


def test_mixing_comes_near_its_targets(spark):
    """Also with a source most of whose words are in one document, and with columns of the names used inside."""
    rows = [*sized_rows(), (9000, "w " * 30_000, "s1"), (9001, None, "s1"), (9002, "", None)]
    clash = ("n", "take", "salts", "whole", "row", "size", "u", "tie", "rank", "left", "_s", "spans", "due", "_copies")
    df = spark.createDataFrame([(*r, *[r[0]] * len(clash)) for r in rows], "doc_id long, text string, source string, " + ", ".join(f"{c} long" for c in clash))
    mixed = mixing.mix(df)
    assert mixed.columns == [*df.columns[:-1], "_size", "_source_size", "_target", "_copies"]
    got = rows_of(mixed)
    assert all(r[c] == r["doc_id"] for r in got for c in clash[:-1])
    _, target, copies = plain_mix(rows)
    assert {(r["doc_id"], r["_copies"]) for r in got} == {(d[0], c) for d, c in copies.items()}
    taken = Counter()
    for r in got:
        taken[r["source"]] += r["_copies"] * r["_size"]
    assert sum(target.values()) == pytest.approx(1.5 * sum(len(r[1] or "") // 2 for r in rows))
    assert all(abs(taken[s] - t) <= 0.01 * t for s, t in target.items())


def test_inclusion_decides_the_sample(spark):
    """Without the odds of inclusion another sample comes out; with them longer documents are likelier."""
    rows = sized_rows()
    got = {r["doc_id"]: r["_copies"] for r in rows_of(mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")))}
    plain = {d[0]: c for d, c in plain_mix(rows, weighed=False)[2].items()}
    assert sum(got[i] != plain[i] for i in got) > 50
    again = [len(r[1]) for r in rows if got[r[0]] == 2 and r[2] in ("s1", "s4")]
    assert np.mean(again) > 1.1 * np.mean([len(r[1]) for r in rows if r[2] in ("s1", "s4")])


def plain_ppm(texts, wanted):
    """The same model, spelled out with dictionaries, for one context order after another."""
    count = [Counter() for _ in range(ppm.ORDER + 1)]
    body = lambda t: ppm.PAD * ppm.ORDER + (b" ".join(t) + b" " if t else b"") + ppm.END
    for t in texts:
        b = body(t)
        for p in range(ppm.ORDER, len(b)):
            for k in range(ppm.ORDER + 1):
                count[k][b[p - k : p], b[p]] += 1
    nodes = [{} for _ in count]
    for k, c in enumerate(count):
        for (ctx, s), n in c.items():
            nodes[k].setdefault(ctx, {})[s] = n
    out = []
    for t in wanted:
        b, score = body(t), 0.0
        for p in range(ppm.ORDER, len(b)):
            gone = set()
            for k in range(ppm.ORDER, -1, -1):
                node = {s: n for s, n in nodes[k].get(b[p - k : p], {}).items() if s not in gone}
                if not node:
                    continue
                total = sum(node.values())
                if b[p] in node:
                    score += math.log10((node[b[p]] - ppm.DISCOUNT) / total)
                    break
                score += math.log10(ppm.DISCOUNT * len(node) / total)
                gone |= set(node)
            else:
                score -= math.log10(256 - len(gone))
        out.append(score)
    return out


def test_ppm(docs, monkeypatch):
    monkeypatch.setattr(ppm, "SLICE", 700)
    monkeypatch.setattr(ppm, "CHUNK_BYTES", 9000)
    data = corpus()
    held = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 2 for r in data]
    words = [[w.encode() for w in toks(r[1])] for r in data]
    train = [w for w, h in zip(words, held) if not h]
    c = Counter(x for w in train for x in [*w, None])
    n, v = sum(c.values()), len(c)
    scores = plain_ppm(train, words)
    want = sorted((str(r[0]), h, len(w) + 1, sum(c[x] > 0 for x in [*w, None]), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in [*w, None]), 4), round(s, 2)) for r, h, w, s in zip(data, held, words, scores))
    got = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4), round(r["score"], 2)) for r in rows_of(ppm.score_documents(docs)))
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], abs=0.03)
    assert ppm.score_documents(docs.where("false")).count() == 0


def test_language_gradients():
    net = langid.Network(["a", "b"], seed=1)
    net.w = {k: x.astype(np.float64) for k, x in net.w.items()}
    x, mask = langid.padded([b"hello", b"yz", b"abcdefg"])
    label = np.array([0, 1, 0])
    g, _ = net.gradients(x, mask, label)
    rng = np.random.default_rng(0)
    for name in ("V", "c", "Uf", "Ub", "Wf", "bb", "E"):
        at = tuple(rng.integers(0, s) for s in net.w[name].shape) if name != "E" else (ord("l"), 3)
        old, loss = net.w[name][at], []
        for step in (1e-3, -1e-3):
            net.w[name][at] = old + step
            loss.append(net.gradients(x, mask, label)[1])
        net.w[name][at] = old
        assert g[name][at] == pytest.approx((loss[0] - loss[1]) / 2e-3, abs=2e-4), name


def plain_pool(net, text, span, context):
    """Mean log probabilities by one state after another, without arrays over lanes."""
    sig = lambda v: 1 / (1 + np.exp(-v))
    h, total = langid.HIDDEN, np.zeros(len(net.labels))
    for a in range(0, len(text), span):
        b = min(a + span, len(text))
        lo, hi = max(0, a - context), min(len(text), b + context)
        states = {}
        for side, order in (("f", range(lo, hi)), ("b", range(hi - 1, lo - 1, -1))):
            s = np.zeros(h)
            for p in order:
                g = net.w["E"][text[p]] @ net.w[f"W{side}"] + net.w[f"b{side}"]
                u = net.w[f"U{side}"]
                z, r = sig(g[:h] + s @ u[:, :h]), sig(g[h : 2 * h] + s @ u[:, h : 2 * h])
                s = (1 - z) * s + z * np.tanh(g[2 * h :] + (r * s) @ u[:, 2 * h :])
                states[side, p] = s
        for p in range(a, b):
            y = np.r_[states["f", p], states["b", p]] @ net.w["V"] + net.w["c"]
            total += y - np.log(np.exp(y).sum())
    mean = np.exp(total / len(text))
    return mean / mean.sum()


def test_language_pooling_against_plain_loops(monkeypatch):
    monkeypatch.setattr(langid, "SPAN", 16)
    monkeypatch.setattr(langid, "CONTEXT", 5)
    monkeypatch.setattr(langid, "LANES", 7)
    net = langid.Network(["a", "b", "c"], seed=3)
    net.w = {k: x.astype(np.float64) for k, x in net.w.items()}
    rng = np.random.default_rng(4)
    texts = [bytes(rng.integers(0, 256, n).astype(np.uint8)) for n in (1, 2, 15, 16, 17, 21, 40, 333)] + [b""]
    best, score = langid.pool(net, texts)
    for t, i, p in zip(texts[:-1], best, score):
        want = plain_pool(net, t, 16, 5)
        assert i == want.argmax() and p == pytest.approx(want.max(), abs=1e-9)
    assert score[-1] == pytest.approx(1 / 3)


def test_language_id(spark):
    rng = np.random.default_rng(3)
    langs = {"aa": vocabulary(80, 21), "bb": [w.replace("a", "ö").replace("e", "ßu") + "k" for w in vocabulary(80, 22)]}
    rows = [(i, " ".join(rng.choice(langs[k], 30)), k) for i in range(120) for k in [("aa", "bb")[i % 2]]]
    rows += [(500, None, "aa"), (501, "", "bb"), (502, "12 34 !!", None), (None, rows[0][1], None), (503, rows[1][1] * 400, None)]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, _score double")
    got = rows_of(langid.identify(df))
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] in (500, 501, 502):
            assert r["_lang_pred"] == "und" and r["_score"] == 0
        elif r["lang"]:
            assert r["_lang_pred"] == r["lang"] and 0.5 < r["_score"] <= 1
        assert r["_held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    assert next(r["_lang_pred"] for r in got if r["doc_id"] == 503) == "bb"
    assert {r["_lang_pred"] for r in rows_of(langid.identify(df.withColumn("lang", F.lit(None).cast("string"))))} == {"und"}
    assert langid.identify(df.where("false")).count() == 0


def test_lines(spark):
    common = "this is a line that stands in many of the documents of the corpus, word for word, always, and it goes on long enough that one word more or less in it is but a small part of the whole of it"
    near = common.replace("many", "most")
    other = "quite another sentence with nothing in common with the rest of them at all, as one can see, though it too has to have a good many words to be told apart from lines of its own kind"
    rows = [(3, f"{common}\nshort\n{other}"), (1, f"short\n{common}"), (2, f"{near}\nshort\n"), (4, None), (5, ""), (None, other + " indeed"), (6, f"{common}\n{common}"), (1, f"short\n{common}")]
    clash = ("_n_kept", "_d", "_gone", "_key", "key", "row", "gone", "k", "_k", "pos", "line")
    df = spark.createDataFrame([(*r, *[i] * len(clash)) for i, r in enumerate(rows)], "doc_id long, text string, " + ", ".join(f"{c} int" for c in clash))
    out = lines.dedup_lines(df)
    assert out.columns == ["doc_id", "text", *clash[1:], "_n_removed", "_n_kept"]
    got = {(r["doc_id"], r["text"], r["_n_removed"], r["_n_kept"]) for r in rows_of(out)}
    assert got == {(3, "", 3, 0), (1, f"short\n{common}", 0, 2), (2, "", 2, 1), (4, None, 0, 0), (5, "", 0, 1), (None, other + " indeed", 0, 1), (6, "", 2, 0)}
    assert out.count() == len(rows) and {r["_key"] for r in rows_of(out)} == set(range(len(rows))) and lines.dedup_lines(df.where("false")).count() == 0


def line_components(texts, similarity=0.75):
    """Brute force: lines' components by the exact similarity of all pairs of sets."""
    sets = [{t[k : k + 5] for k in range(max(1, len(t) - 4))} for t in texts]
    top = list(range(len(texts)))
    links = [(i, j) for i, j in combinations(range(len(texts)), 2) if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j])]
    for i, j in links:
        a, b = sorted((top[i], top[j]))
        top = [a if x == b else x for x in top]
    return top, links


def near_lines(seed, families, size):
    """Families of lines with more and fewer characters changed, about the threshold and above."""
    rng = np.random.default_rng(seed)
    words, out = vocabulary(400, seed), []
    for _ in range(families):
        base = list(" ".join(rng.choice(words, rng.integers(1, 30))))
        for _ in range(size):
            t = list(base)
            for p in rng.choice(len(t), rng.integers(0, max(2, len(t) // 20)), replace=False):
                t[p] = "#"
            out.append("".join(t))
    return sorted(set(out), key=lambda t: hashlib.md5(t.encode()).digest())


def test_line_dedup_against_brute_force(spark):
    """Recall of removed lines, and none removed that brute force keeps, over lines of 2 to 250 characters."""
    texts = [*near_lines(51, 60, 6), "x" * 120_000, "x" * 119_990 + "y" * 20, "z", "é", "ab", "abcd"]
    top, links = line_components(texts)
    got = lines.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    gone = {r["doc_id"] for r in got.where("_n_removed > 0").collect()}
    want = {i for i, t in enumerate(top) if t != i}
    assert len(want) > 100 and len(gone & want) >= 0.98 * len(want)
    assert gone <= want


def test_map_of_repeated_hashes(spark):
    rng = np.random.default_rng(23)
    once, twice = (rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2) for n in (3000, 500))
    rows = [(h.tobytes(),) for h in np.array_split(rng.permutation(np.r_[once, twice, twice, twice[:100]]), 40)]
    found = common.repeated_map(spark.createDataFrame(rows, "keys binary"), "keys", 4000)
    assert common.in_map(found, twice).all() and common.in_map(found, once).mean() < 0.01
    assert not common.repeated_map(spark.createDataFrame([(once.tobytes(),)], "keys binary"), "keys", 0).any()


@pytest.mark.parametrize("listed", [lines.LISTED, 1])
def test_line_links_are_exact_within_buckets(listed, monkeypatch):
    """All lines in one bucket, or in several: the links join just what brute force joins."""
    monkeypatch.setattr(lines, "LISTED", listed)
    texts = near_lines(52, 8, 4)[:30]
    for cuts in ([0, len(texts)], [0, 2, 9, 10, len(texts)]):
        pdf = pd.DataFrame({"node": range(100, 100 + len(texts)), "line": texts})
        i, j = lines.line_links(pdf, np.array(cuts), 0.75)
        parts = [line_components(texts[a:b])[0] for a, b in zip(cuts, cuts[1:])]
        want = [t + a for a, p in zip(cuts, parts) for t in p]
        got = list(range(len(texts)))
        for a, b in zip(i.tolist(), j.tolist()):
            p, q = sorted((got[a], got[b]))
            got = [p if x == q else x for x in got]
        assert got == want and len(i) == len(texts) - len(set(want))


def test_equal_short_lines_are_removed_by_the_query(spark, tmp_path):
    rows = [(1, "Menu\n\nMenu\nMenus"), (2, "Menu\n \nHome"), (3, "Menu")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["n_removed"], r["n_kept"], r["text_sha256"]) for r in rows_of(queries.op8_line_dedup(spark, str(tmp_path)))}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {1: (1, 3, sha("Menu\n\nMenus")), 2: (1, 2, sha(" \nHome")), 3: (1, 0, sha(""))}


def test_lines_with_one_changed_word_are_near(spark):
    rng = np.random.default_rng(7)
    words, rows = vocabulary(3000, 41), []
    for i in range(40):
        line = [str(w) for w in rng.choice(words, 20)]
        near = [*line[:9], "changed", *line[10:]]
        rows += [(2 * i, " ".join(line)), (2 * i + 1, " ".join(near))]
    sets = [{t[k : k + 5] for k in range(len(t) - 4)} for _, t in rows]
    near = {2 * i + 1 for i in range(40) if 4 * len(sets[2 * i] & sets[2 * i + 1]) >= 3 * len(sets[2 * i] | sets[2 * i + 1])}
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    gone = {r["doc_id"] for r in got.where("_n_removed > 0").collect()}
    assert gone <= near and len(near) > 30 and len(gone) >= len(near) - 2


def test_minhash_values_are_independent(monkeypatch):
    """Pairs of sets with 6 of 8 hashes in common: agreeing values are as many, and spread as far, as by chance."""
    rng = np.random.default_rng(12)
    n, sets = lines.BANDS * lines.ROWS, []
    for _ in range(1000):
        h = rng.integers(0, 2**63, 8).astype(np.uint64)
        sets += [h, h[:6]]
    monkeypatch.setattr(lines, "shingles", lambda _: (np.concatenate(sets) << np.uint64(1), np.array(list(map(len, sets)))))
    m = lines.signatures([])
    agree = m[::2] == m[1::2]
    count = agree.sum(1)
    assert count.mean() / n == pytest.approx(0.75, abs=0.01)
    assert count.var() < 1.3 * n * 0.75 * 0.25
    assert agree.reshape(1000, lines.BANDS, lines.ROWS).all(2).any(1).mean() > 0.985


def test_bands_have_their_recall_at_every_size():
    """Pairs at a similarity of 0.75 exactly, 3 of 4 shingles and so on: the share with a common band."""
    rng = np.random.default_rng(12)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    for n in (3, 6, 30, 150):
        texts = ["".join(rng.choice(letters, n * 4 // 3 + 4)) for _ in range(2000 if n < 100 else 500)]
        (a, x), (b, y) = lines.band_keys(texts), lines.band_keys([t[: n + 4] for t in texts])
        assert (a == b).any(1).mean() > 0.985, n
        sig = [r.tobytes() for r in lines.packed(np.concatenate([x, y]))]
        assert (lines.unpacked(sig) == np.concatenate([x, y])).all()
        rows = np.stack([np.arange(len(texts)), np.arange(len(texts)) + len(texts)], axis=1).ravel()
        pdf = pd.DataFrame({"key": rows % len(texts), "node": rows, "sig": [sig[i] for i in rows]})
        assert len(lines.promising(pdf, np.arange(0, len(rows) + 1, 2), 0.75)) >= 0.999 * len(rows)
        (_, x), size = lines.band_keys(["".join(rng.choice(letters, 90)) for _ in range(200)]), 50
        chance = pd.DataFrame({"key": np.arange(200) // size, "node": range(200), "sig": [r.tobytes() for r in lines.packed(x)]})
        assert len(lines.promising(chance, np.arange(0, 201, size), 0.75)) == 0


def every_window(scanner, text):
    """Matches without bands: each template against all shingles of the text, its words found by a pattern."""
    words = [(m[0], m.start(), m.end()) for m in re.finditer(r"(?:[A-Za-z0-9]|[^\x00-\x7f])+", text or "")]
    low = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w, _, _ in words]
    h = licenses._pairs(Words([" ".join(low).encode()], licenses._TABLE))
    out = []
    for t in scanner.templates:
        own = np.flatnonzero(np.isin(h, t.own))
        out += [(t.name, t.license, share, words[a][1], words[b + 1][2]) for a, b, share in t.occurrences(own, h[own])]
    return sorted(out, key=lambda m: (m[3], m[0]))


def license_texts():
    """Each template whole, with a word changed, twice, and cut, among other words; also very long."""
    rng = np.random.default_rng(1)
    common = "the of and to is under a software this or in license permission copy by any public".split()
    words = [*vocabulary(200, 9), *common]
    pad = lambda n: " ".join(rng.choice(words, n))
    out = []
    for name, t, _ in licenses.TEMPLATES:
        w = t.split()
        changed = list(w)
        changed[len(w) // 2] = "other"
        out += [(name, f"{pad(rng.integers(0, 80))} é {t.upper()}\n{pad(60)}"), (None, f"{pad(9)} {' '.join(changed)} {pad(200)} {t} {pad(3)} {t}"), (None, f"{pad(30)} {' '.join(w[: len(w) * 2 // 3])} {pad(30)}")]
    return [*out, ("MIT", f"{pad(40_000)} released under the MIT license {pad(40_000)}"), (None, pad(3000)), (None, None), (None, ""), (None, "license")]


def test_licenses_against_every_window():
    scanner, data = licenses.Scanner(), license_texts()
    got = scanner.scan([t for _, t in data])
    for (name, text), found in zip(data, got):
        assert found == every_window(scanner, text)
        assert name is None or name in {m[1] for m in found}
        assert all(m[2] >= 0.8 and 0 <= m[3] < m[4] <= len(text) for m in found)
    assert sum(len(m) for m in got) > 3 * len(licenses.TEMPLATES)
    for (_, t), one in zip(data, got):
        assert scanner.scan([t]) == [one]  # alone or among others


def test_licenses_are_told_apart():
    found = lambda t: {m[1] for m in licenses.Scanner().scan([t])[0]}
    assert found("It is licensed under the GNU General Public License, version 2.") == {"GPL-2.0"}
    assert found("Licensed under the MIT License") == found("released under the MIT license.") == {"MIT"}
    assert found("Licensed under CC BY-NC 4.0.") == {"CC-BY-NC-4.0"} and found("under the BSD 2-Clause License") == {"BSD-2-Clause"}
    three = [t for n, t, _ in licenses.TEMPLATES if n == "BSD"][0] + " " + [t for n, t, _ in licenses.TEMPLATES if n == "BSD-3-Clause"][0]
    assert found(three) == {"BSD", "BSD-3-Clause"}
    (match,) = licenses.Scanner().scan(["of the thing is under the MIT License"])[0]
    assert match[3:] == (16, 37)


def test_licenses(spark):
    rows = [(1, "x released under the MIT License.", 0), (1, "x released under the MIT License.", 1), (2, None, 2), (None, "", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _matches int")
    assert sorted([m["license"] for m in r["_matches"]] for r in licenses.scan(df).collect()) == [[], [], ["MIT"], ["MIT"]]
    assert licenses.scan(df.where("false")).count() == 0


def test_digest_of_kept_text():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


def test_sketches_bound_the_difference_of_sets():
    rng = np.random.default_rng(5)
    for n in (1, 20, 300, 3000):
        x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        y = np.unique(np.r_[x[: n * 3 // 4], rng.integers(0, 2**63, n // 3).astype(np.uint64)])
        size = min(len(sketches.sketch(x)), len(sketches.sketch(y)))
        a, b = (sketches._matrix([sketches.sketch(h)], size)[0] for h in (x, y))
        bits = int(np.bitwise_count(a ^ b).sum())
        assert bits <= len(np.setxor1d(x, y)) and bits % 2 == len(np.setxor1d(x, y)) % 2


def test_sketched_pairs_lose_no_link():
    """Near copies of a few sets of many sizes, in buckets: every linked pair of two components is found."""
    rng = np.random.default_rng(15)
    sets = []
    for n in (3, 14, 60, 250, 1500):
        base = rng.integers(1, 2**63, n).astype(np.uint64)
        sets += [np.unique(np.r_[base[rng.random(n) > rng.random() / 4], rng.integers(1, 2**63, int(n * rng.random() / 6)).astype(np.uint64)]) for _ in range(12)]
    sets = [s for s in sets if len(s)]
    pdf = pd.DataFrame({"n": list(map(len, sets)), "comp": rng.integers(0, 9, len(sets)), "sketch": list(map(sketches.sketch, sets))})
    bounds = np.array([0, 1, 20, len(sets)])
    found = set(map(tuple, np.sort(np.array(sketches.sketched_pairs(pdf, bounds, 75, 100)).T, axis=1).tolist()))
    linked = 0
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        for i, j in combinations(range(lo, hi), 2):
            common = len(np.intersect1d(sets[i], sets[j]))
            if pdf.comp[i] != pdf.comp[j] and 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                linked += 1
                assert (i, j) in found
                assert sketches.may_link([len(sets[i])], [pdf["sketch"][i]], [len(sets[j])], [pdf["sketch"][j]], 75, 100).all()
    assert 20 < linked <= len(found) < 4 * linked
    best = np.sort(np.array(sketches.sketched_pairs(pdf, bounds, 75, 100, True)).T, axis=1).tolist()
    apart = {frozenset((pdf.comp[i], pdf.comp[j])) for i, j in found}
    assert set(map(tuple, best)) <= found and sorted(map(sorted, apart)) == sorted(sorted((pdf.comp[i], pdf.comp[j])) for i, j in best)
    sizes = [sketches.places(n) for n in range(1, 20000)]
    assert all(sizes[-(-3 * n // 4) - 1] in (sizes[n - 1], sizes[n - 1] // 2) for n in range(1, 20000))


def test_blocks_of_a_large_bucket_meet(spark, monkeypatch):
    """Every pair of a bucket is compared, whatever the blocks; equal buckets are compared once."""
    monkeypatch.setattr(graph, "BLOCK", 7)
    monkeypatch.setattr(graph, "GROUP_ROWS", 10)
    rows = spark.createDataFrame([(k, i) for k in (1, 2) for i in range(40)] + [(3, 50), (4, 50), (4, 51)], "key long, node long")
    placed = graph.split_buckets(rows, spark.createDataFrame([(i, 0) for i in range(5)], "node long, comp long"))
    assert sorted(r["n"] for r in placed.select("key", "n").distinct().collect()) == [2, 40]

    def compare(pdf, bounds):
        pairs = [(i, j) for lo, hi in zip(bounds[:-1], bounds[1:]) for i, j in combinations(range(lo, hi), 2) if pdf.comp[i] != pdf.comp[j]]
        return tuple(np.array(pairs, np.int64).reshape(-1, 2).T)

    found = {tuple(r) for r in graph.compared(placed, rows.select("node").distinct(), compare).collect()}
    assert found == {(i, j) for i, j in combinations(range(40), 2) if j >= 5} | {(50, 51)}
