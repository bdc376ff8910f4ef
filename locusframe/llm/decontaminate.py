"""Benchmark decontamination by winnowed fingerprints, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, materialize, release, small

#: Words of a window and of a fingerprint; in a window, SPAN - GRAM + 1 fingerprints compete.
SPAN, GRAM = 13, 5
#: What parts words here: the ASCII characters but letters and digits. All else, beyond ASCII too, is of words.
PARTING = "".join(map(chr, [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def _tokens(text: str) -> Column:
    """Words of a text, A-Z in lower case: one translation, then a split at single spaces."""
    plain = F.translate(text, UPPER + PARTING, LOWER + " " * len(PARTING))
    return F.coalesce(F.array_remove(F.split(plain, " "), ""), F.array().cast("array<string>"))


def _shifted(df: DataFrame, name: str, left: str, right: str, by: int, f) -> DataFrame:
    """Adds an array: f of each element of `left` and the one of `right` that lies `by` places after it."""
    n = F.least(F.size(left), F.size(right) - by)
    return df.withColumn(name, F.zip_with(F.slice(left, F.lit(1), n), F.slice(right, F.lit(by + 1), n), f))


def _runs(df: DataFrame, name: str, items: str, width: int, f) -> DataFrame:
    """Adds an array: f folded over each `width` consecutive elements, by doubling.

    Every step is a column of its own, used twice, so that it is computed once.
    """
    at, span = items, 1
    while span < width:
        by = min(span, width - span)
        # Overlapping runs do for a minimum; for hashes the rest is added from single elements.
        if by < span and f is _pair_hash:
            while span < width:
                df, at, span = _shifted(df, f"{name}_{span}x", at, items, span, f), f"{name}_{span}x", span + 1
            break
        df, at, span = _shifted(df, f"{name}_{span}", at, at, by, f), f"{name}_{span}", span + by
    return df.withColumn(name, F.col(at))


def _pair_hash(a: Column, b: Column) -> Column:
    return F.xxhash64(a, b)


def _least(a: Column, b: Column) -> Column:
    return F.least(a, b)


def grams(df: DataFrame, words: str, gram: int) -> DataFrame:
    """Adds _g: hashes of each `gram` consecutive words; every word is hashed once."""
    return _runs(df.withColumn("_w", F.transform(words, lambda x: F.xxhash64(x))), "_g", "_w", gram, _pair_hash)


def winnow(df: DataFrame, keys: list[str], words: str, span: int, gram: int) -> DataFrame:
    """Winnowed fingerprints of an array of words: the columns `keys`, h, and at (from 1).

    Of each window of `span` words the least hash of `gram` words stays, ordered by its upper 32
    bits and then by its place, which are one number.
    """
    hashed = grams(df.where(F.size(words) >= span).select(*keys, words), words, gram)
    numbered = hashed.withColumn("_p", F.transform("_g", lambda h, i: h.bitwiseAND(F.lit(-(1 << 32))).bitwiseOR((i + 1).cast("long"))))
    least = _runs(numbered, "_m", "_p", span - gram + 1, _least)
    at = F.transform(F.array_distinct("_m"), lambda m: m.bitwiseAND(F.lit((1 << 32) - 1)).cast("int"))
    found = least.select(*keys, F.explode(F.transform(at, lambda i: F.struct(i.alias("at"), F.get("_g", i - 1).alias("h")))).alias("f"))
    return found.select(*keys, "f.h", "f.at")


def contaminated_words(docs: DataFrame, items: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """For each document the words that lie inside an occurrence of a benchmark window.

    `docs` has doc_id and text, `items` item_id and text. A window is `span` consecutive words of
    an item, or all words of a shorter one. Fingerprints are winnowed on both sides: the least
    hash of `gram` consecutive words in each window of `span`, so that every shared window shares
    a fingerprint. Distinct fingerprints of the benchmark are joined (broadcast if their counted rows
    are few, else both sides are shuffled) with those of the documents; only hashes and places
    travel. Each hit is extended to the windows that hold it, and these are compared with the
    distinct windows of the benchmark, word by word. Items shorter than a span are looked up by the
    hash of all their words in the same way. Items are met at the end, by the windows found.

    Returns doc_id, text_key (xxhash64 of the text), n_words, hits (array of struct(start, end),
    1-based and inclusive), items (sorted array). Null or empty texts: 0 words, no hits. Null
    items and items without words have no windows; a null item_id is left out. Repeated documents
    come out as often as they came in; repeated items count once per item_id. Empty tables:
    no rows, or no hits. Columns other than the named ones are ignored.
    """
    keys = ["doc_id", "text_key"]
    src = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    toks = src.select(*keys, _tokens("text").alias("w"))
    bench = materialize(items.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), _tokens("text").alias("w")).where(F.size("w") > 0).distinct())
    wide = F.least(F.lit(span), F.size("w"))
    starts = F.sequence(F.lit(1), F.size("w") - wide + 1)
    windows, _ = small(bench.select("item_id", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, wide), " "))).alias("window")).distinct())
    distinct, _ = small(windows.select("window").distinct())

    # Places of shared fingerprints, with the first and last start of the windows that hold them.
    prints, _ = small(winnow(bench, ["item_id"], "w", span, gram).select("h").distinct())
    spots = winnow(toks, keys, "w", span, gram).join(prints, "h").select(*keys, F.lit(span).alias("width"), (F.col("at") - (span - gram)).alias("lo"), F.col("at").alias("hi"))
    lengths = [r["n"] for r in bench.where(F.size("w") < span).select(F.size("w").alias("n")).distinct().collect()]  # at most span - 1
    for n in sorted(lengths):
        whole, _ = small(grams(bench.where(F.size("w") == n), "w", n).select(F.col("_g")[0].alias("h")).distinct())
        each = grams(toks.where(F.size("w") >= n), "w", n).select(*keys, F.posexplode("_g").alias("at", "h"))
        spots = spots.unionByName(each.join(whole, "h").select(*keys, F.lit(n).alias("width"), (F.col("at") + 1).alias("lo"), (F.col("at") + 1).alias("hi")))
    by_doc, _ = small(spots.groupBy(*keys).agg(F.collect_set(F.struct("width", "lo", "hi")).alias("spots")))

    # Only documents with a shared fingerprint are split into words again.
    same = F.col("s.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("s.text_key") == F.col("b.text_key"))
    met = src.alias("s").join(by_doc.alias("b"), same).select("s.doc_id", "s.text_key", _tokens("text").alias("w"), "spots")
    n = F.size("w")
    places = F.array_distinct(F.flatten(F.transform("spots", lambda s: F.transform(
        F.sequence(F.greatest(F.lit(1), s["lo"]), F.least(s["hi"], n - s["width"] + 1)), lambda i: F.struct(i.alias("start"), s["width"].alias("width"))))))
    seen = met.select(*keys, F.explode(F.transform(places, lambda p: F.struct(p["start"].alias("start"), (p["start"] + p["width"] - 1).alias("end"), F.array_join(F.slice("w", p["start"], p["width"]), " ").alias("window")))).alias("x"))
    hits = materialize(seen.select(*keys, "x.start", "x.end", "x.window").join(distinct, "window", "left_semi").distinct())
    release(by_doc)
    marked = hits.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("hits"))
    named = hits.select(*keys, "window").distinct().join(windows, "window").groupBy(*keys).agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    found, _ = small(marked.alias("m").join(named.alias("i"), F.col("m.doc_id").eqNullSafe(F.col("i.doc_id")) & (F.col("m.text_key") == F.col("i.text_key"))).select(
        F.col("m.doc_id").alias("d"), F.col("m.text_key").alias("k"), "hits", "items"))
    release(hits, windows, distinct, prints, bench)
    sizes = toks.select(*keys, F.size("w").cast("long").alias("n_words"))
    return sizes.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")), "left").drop("d", "k")


def n_hit(hits: str = "hits") -> Column:
    """Words covered by sorted, possibly overlapping intervals."""
    covered = F.aggregate(
        hits,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda acc, x: F.struct(
            (acc["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(acc["end"], x["start"] - 1))).cast("long").alias("n"), F.greatest(acc["end"], x["end"]).alias("end")
        ),
    )
    return F.coalesce(covered["n"], F.lit(0).cast("long"))
