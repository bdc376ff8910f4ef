"""Ranked search, vector codes and toxicity against brute force on small tables with nulls, ties, repeats and odd values."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from locusframe.llm import codes, lexical, oracles, queries, toxicity
from locusframe.llm.toxicity import Finder, Model, Trie

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# --- ranked lexical search ---


def ranked(docs, items, k=10):
    """(item_id, rank, doc_id, score) by the stated rule, document by document."""
    tf = [(i, Counter(TERM.findall(lower(t)))) for i, t in docs if t is not None]
    tf = [(i, c) for i, c in tf if c]
    n, l_all = len(tf), sum(sum(c.values()) for _, c in tf)
    df = Counter(t for _, c in tf for t in c)
    out = []
    for item, text in items:
        q = Counter(TERM.findall(lower(text or "")))
        got = []
        for i, c in tf:
            m = 100 - 75 + (75 * sum(c.values()) * n) // l_all
            s = sum(k_ * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t, k_ in q.items() if t in c)
            if s > 0:
                got.append((-s, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(got, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def small_corpus():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4))) for _ in range(60)]
    make = lambda n: rng.choice([" ", ", ", "\n", "-"]).join(rng.choices(vocabulary, range(60, 0, -1), k=n))
    docs = [(i, make(rng.randint(1, 40))) for i in range(150)]
    docs += [(500 + i, docs[7][1]) for i in range(15)]  # copies: equal scores
    docs += [(900, None), (901, ""), (902, " .,;"), (903, make(3000).upper()), (None, docs[3][1]), (7, docs[7][1]), (7, make(5)), (2**63 - 1, docs[7][1]), (2**53 + 1, docs[7][1])]
    items = [(1, make(8)), (2, docs[7][1]), (2, docs[3][1]), (3, None), (4, ""), (5, "zzzz"), (6, "É a a a B"), (None, make(4)), (8, make(200)), (1, make(8))]
    return docs, items


@pytest.mark.parametrize("block, shard, text_bytes", [(32, 8192, 1 << 18), (2, 16, 1 << 18), (4, 64, 60)])
def test_ranked_search(spark, monkeypatch, block, shard, text_bytes):
    monkeypatch.setattr(lexical, "BLOCK", block)
    monkeypatch.setattr(lexical, "SHARD", shard)
    monkeypatch.setattr(lexical, "QUERY_BYTES", text_bytes)
    monkeypatch.setattr(lexical, "FIRST", 20)
    docs, items = small_corpus()
    d = spark.createDataFrame([(i, t, 5, "x") for i, t in docs], "doc_id long, text string, score int, row string").repartition(3)
    got = lexical.search(d, spark.createDataFrame(items, "item_id long, text string")).select("item_id", "rank", "doc_id", "score").collect()
    assert sorted(map(tuple, got), key=str) == ranked(docs, items)


def test_ranked_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical.search(docs, items).collect() == []
    assert lexical.search(items.withColumnRenamed("item_id", "doc_id"), docs.withColumnRenamed("doc_id", "item_id")).columns == ["item_id", "rank", "doc_id", "score"]


def test_summaries_bound_their_members():
    rng = np.random.default_rng(1)
    length = rng.integers(1, 9, 300)
    first = np.r_[0, np.cumsum(length)]
    term = np.concatenate([np.sort(rng.choice(12, n, replace=False)) for n in length])
    shard = lexical.Shard(first, term, rng.integers(1, 1000, len(term)).astype(float), np.ones(12, np.int64))
    seen = []
    for p in range(len(shard.terms)):
        docs, begins = shard.blocks(p)
        assert sorted(docs.tolist()) == np.flatnonzero([shard.terms[p] in term[a:b] for a, b in zip(first, first[1:])]).tolist()
        seen += np.diff(np.r_[begins, len(docs)]).tolist()
    assert max(seen) <= 2 * lexical.BLOCK and min(seen) >= 1


# --- codes of vectors ---


def coded(rows, rounds=6):
    """(vec_id, code, error, label, digest) by plain loops over whole numbers."""
    kept = [(i, [math.floor(4096 * x) for x in v], y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    d = len(kept[0][1])
    cut = [i * d // 8 for i in range(9)]
    firsts = {}
    for i, v, _ in kept:
        if i is not None:
            firsts[i] = min(firsts.get(i, v), v)
    books = [[firsts[i][cut[p] : cut[p + 1]] for i in sorted(firsts)[:16]] for p in range(8)]
    near = lambda v, p: min((sum((a - b) ** 2 for a, b in zip(v[cut[p] : cut[p + 1]], e)), j) for j, e in enumerate(books[p]))
    for _ in range(rounds):
        new = []
        for p in range(8):
            members = {}
            for _, v, _ in kept:
                members.setdefault(near(v, p)[1], []).append(v[cut[p] : cut[p + 1]])
            new.append([[sum(c) // len(members[j]) for c in zip(*members[j])] if j in members else e for j, e in enumerate(books[p])])
        books = new
    name = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = []
    for i, v, y in kept:
        found = [near(v, p) for p in range(8)]
        out.append((i, "".join(f"{j:02x}" for _, j in found), min(sum(x for x, _ in found), 2**63 - 1), y, name))
    return sorted(out, key=str)


def vectors(seed, n=90, d=24):
    rng = np.random.default_rng(seed)
    centre = rng.normal(0, 0.3, (5, d))
    rows = [(int(i), [float(x) for x in centre[i % 5] + rng.normal(0, 0.05, d)], int(i % 3) if i % 7 else None) for i in rng.permutation(n)]
    rows += [(1000 + i, rows[0][1], 1) for i in range(40)]  # copies
    rows += [(3, rows[1][1], 2), (3, rows[1][1], 2), (None, rows[2][1], None), (2000, None, 1), (2001, [None] * d, 1), (2002, [float("nan")] + [0.0] * (d - 1), 1), (2003, [float("inf")] * d, None)]
    return rows


@pytest.mark.parametrize("owner_rows", [1 << 16, 10])
def test_vector_codes(spark, monkeypatch, owner_rows):
    monkeypatch.setattr(codes, "OWNER_ROWS", owner_rows)
    rows = vectors(2)
    df = spark.createDataFrame([(*r, 1, "q") for r in rows], "vec_id long, embedding array<double>, label int, n int, q string").repartition(3)
    got = codes.compress(df.drop("q")).select("vec_id", "_code", "_error", "label", "_books").collect()
    assert sorted(map(tuple, got), key=str) == coded(rows)


def test_vector_codes_of_huge_numbers_and_odd_lengths(spark):
    rows = [(i, [1e30 * i, -3.0, 1e-300, 0.5 * i, 1e15], 1) for i in range(20)]
    schema = "vec_id long, embedding array<double>, label int"
    got = codes.compress(spark.createDataFrame(rows + [(50, [], 1), (51, [1.0], None), (None, [1.0, 2.0], 1)], schema)).select("vec_id", "_code", "_error", "label", "_books").collect()
    assert sorted((tuple(r) for r in got if r["vec_id"] is not None and r["vec_id"] < 50), key=str) == coded(rows)
    rest = {r["vec_id"]: r for r in got if r["vec_id"] is None or r["vec_id"] >= 50}
    assert rest[50]["_code"] == rest[51]["_code"] == "00" * 8 and rest[None]["_code"] is None and rest[None]["_error"] == 0
    assert codes.compress(spark.createDataFrame([], schema)).collect() == []


def test_only_movers_are_shuffled(spark):
    data = codes.whole_numbers(spark.createDataFrame(vectors(5), "vec_id long, embedding array<double>, label int")).withColumn("row", F.monotonically_increasing_id())
    books = codes.first_books(data)
    shared = spark.sparkContext.broadcast(books)
    settled = codes._settled(codes._first_owners(data, shared, 2)).cache()
    assert settled.where("moved").count() == 0
    same = codes._stay_or_move(settled, shared)
    assert same.where("moved").count() == 0 and same.agg(F.sum("n")).first()[0] == data.count() * 8
    moved = codes._stay_or_move(settled, spark.sparkContext.broadcast(codes._updated(settled, books)))
    assert 0 < moved.where("moved").agg(F.sum("n")).first()[0] < data.count() * 8 and moved.agg(F.sum("n")).first()[0] == data.count() * 8


def test_sql_of_search_and_codes(spark, tmp_path):
    docs, items = small_corpus()
    spark.createDataFrame([(i, t) for i, t in docs if i is not None], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([x for x in items if x[0] not in (1, 2)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([r for r in vectors(4) if r[0] is not None and r[0] != 3], "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    c = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        c.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    for name, sql in (("op11_lexical_search", oracles.OP11), ("op12_vector_codes", oracles.OP12)):
        got, want = queries.QUERIES[name](spark, str(tmp_path)), c.sql(sql)
        assert sorted(got.columns) == sorted(want.columns)
        rows = lambda found, names: sorted(str(tuple(r[names.index(x)] for x in sorted(names) if x != "doc_id")) for r in found)
        # Documents of one id and equal scores take their ranks in any order.
        assert rows(got.collect(), got.columns) == rows(want.fetchall(), want.columns)


# --- toxicity ---


def distances(a, b):
    """Edit distances of a to all beginnings of b."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row


def test_automata_against_edit_distances():
    rng = random.Random(5)
    terms = [("scum", True), ("idiot", True), ("pathetic", False), ("disgusting", True), ("lowei", False), ("achlicheber", False), ("éèàçô", True), ("idiot", False)]
    words = ["", "a", "x" * 500, "idiot", "1diot", "idioot", "diot", "idoit", "idioten", "disgustng", "dsgustin", "disgustingly", "patheticness", "athetically", "éèàço"]
    for t, _ in terms:
        for _ in range(60):
            w = list(t + rng.choice(["", "", "s", "heit"]))
            for _ in range(rng.randint(0, 3)):
                i = rng.randrange(len(w) + 1)
                w[i : i + rng.randint(0, 1)] = rng.choice(["", rng.choice("abcdeiotsuz1é")])
            words.append("".join(w))
    words = sorted(set(words))
    trie = Trie(terms)
    got = {(words[w], t): d for w, t, d in zip(*(x.tolist() for x in trie.match(words)))}
    want = {}
    for w in words:
        for t, (term, whole) in enumerate(terms):
            row = distances(term, w)
            d = row[-1] if whole else min(row)
            if d <= trie.edits[t]:
                want[w, t] = d
    assert got == want


def toy():
    """Labelled documents: abuse, clean text with a close word, and quotations."""
    rng = random.Random(9)
    plain = ["".join(rng.choice("bdfghklmnprstv") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(300)]
    bad = ["grumok", "blistering", "zorkwit", "flummoxer"]
    docs, labels = [], []
    for i in range(900):
        words = rng.choices(plain, k=rng.randint(5, 80))
        if i % 3 == 0:
            words.append("grumo")  # one edit from a term, in clean documents too
        y = int(i % 8 == 0)
        for _ in range(3 * y):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        docs.append((i, " ".join(words)))
        labels.append((i, y))
    return plain, bad, docs, labels


def test_toxicity(spark):
    plain, bad, docs, labels = toy()
    rng = random.Random(2)
    text = lambda *w: " ".join(rng.choices(plain, k=15) + list(w) + rng.choices(plain, k=15))
    extra = [(5000, text("zorkw1t", "bl1stering", "flumoxer")), (5001, text("flummoxer", "grumok")), (5002, text("grumo")), (5003, None), (5004, ""), (5005, 'they wrote "flummoxer" here'),
             (5006, text()), (None, text("zorkwit", "grumok")), (5007, text("zorkwit") + " pa" * 20000), (5001, text("flummoxer", "grumok")), (5008, "flummoxer zorkwit")]
    d = spark.createDataFrame([(*x, 1, "a") for x in docs + extra], "doc_id long, text string, toxic int, h string").repartition(3)
    y = spark.createDataFrame(labels + [(5002, None), (5003, 1), (77777, 1), (None, 1), (5004, 7)], "doc_id long, toxic int")
    got = toxicity.toxicity(d, y)
    assert got.columns == ["doc_id", "text", "toxic", "h", "_held_out", "_score"]
    rows = got.collect()
    assert len(rows) == len(docs) + len(extra)
    for r in rows:
        assert 0 <= r["_score"] <= 1 and r["_held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    known = dict(labels)
    held = [(known[r["doc_id"]], r["_score"] >= 0.3) for r in rows if r["_held_out"] and r["doc_id"] in known]
    assert sum(a == b for a, b in held) / len(held) > 0.98 and len(held) > 100
    score = {r["doc_id"]: r["_score"] for r in rows if r["doc_id"] is None or r["doc_id"] >= 5000}
    assert score[5000] >= 0.3 and score[5001] >= 0.3 and score[None] >= 0.3 and score[5008] >= 0.3
    assert max(score[i] for i in (5002, 5003, 5004, 5005, 5006)) < 0.3
    again = {(r["doc_id"], r["text"]): r["_score"] for r in toxicity.toxicity(d.repartition(5), y).collect()}
    assert all(again[r["doc_id"], r["text"]] == pytest.approx(r["_score"], abs=1e-9) for r in rows)


def test_held_out_labels_do_not_matter(spark):
    _, _, docs, labels = toy()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, y in labels]
    a, b = ({r["doc_id"]: r["_score"] for r in toxicity.toxicity(d, spark.createDataFrame(x, "doc_id long, toxic int")).collect()} for x in (labels, turned))
    assert a == pytest.approx(b, abs=1e-9)


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["_score"] for r in toxicity.toxicity(docs, none).collect()] == [0.0, 0.0]
    assert toxicity.toxicity(docs.limit(0), none).collect() == []


def test_windows_tell_quotation_from_abuse():
    model = Model([("flummoxer", True)], np.array([50.0]), np.array([0.0]), (100.0, 900.0), clean=np.zeros(1))
    model.trie = Trie(model.terms)
    of = lambda t: toxicity.features(model, Finder(model), [t])[0][1]
    plain, quoted, told = of("you flummoxer go away"), of('he wrote "flummoxer" there'), of("the word flummoxer is an insult")
    assert plain > 3 * quoted and plain > told > quoted
    assert of('"a" flummoxer "b"') > 3 * quoted and of("« flummoxer »") < plain / 3 and of('"\nflummoxer\n"') > 3 * quoted


# --- ids and numbers at the ends of their types ---


def test_ids_next_to_the_ends_of_longs(spark):
    from locusframe.llm import ngram_join, ppm, substrings

    long_text = " ".join(f"w{i}" for i in range(80))
    rows = [(2**53 + 1, "a b c d e f g"), (None, "a b c"), (2**63 - 1, long_text), (2**63 - 3, long_text), (-(2**63), "x"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    for f in (ppm.score_documents, ngram_join.near_duplicates, substrings.remove_repeats):
        assert sorted((r["doc_id"] for r in f(docs).collect()), key=str) == sorted((i for i, _ in rows), key=str)
    joined = {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(docs).collect() if r["doc_id"] is not None}
    assert joined[2**63 - 1] == 2**63 - 3


def test_join_stage_keeps_the_smallest_of_large_ids(spark):
    import corpus_pipeline

    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(2**63 - 1, text), (2**53 + 1, text), (2**53 + 2, "other words here"), (None, text)], "doc_id long, text string").coalesce(1)
    assert sorted((r["doc_id"] for r in corpus_pipeline.join_stage(spark, docs, "").collect()), key=str) == sorted([2**53 + 1, 2**53 + 2, None], key=str)


def test_scores_beyond_longs(spark):
    from locusframe.llm import topk

    rows = [(0, [3e38, 1.0]), (1, [3e38, -1.0]), (2, [-3e38, 0.0]), (3, [1.0, 1.0]), (20, [0.5, 0.5])]
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got[0, 1] == (1, 2**63 - 1) and got[0, 4] == (2, -(2**63)) and len(got) == 8
    assert got[20, 1] == (0, 2**63 - 1) and got[20, 2] == (1, 2**63 - 1) and got[20, 3] == (3, 2 * 64 * 32)
