"""Queries of the operators over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .common import table


def op1_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ppm import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    found = identify(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("_held_out").alias("held_out"), F.col("_lang_pred").alias("lang_pred"), F.col("_score").alias("score"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "utf-8"), 256).alias("kept_sha256"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated_words, n_hit

    found = contaminated_words(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumn("n_hit", n_hit())
    items = F.coalesce("items", F.array().cast("array<string>"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"), F.sha2(F.encode(F.array_join(items, ","), "utf-8"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html import extract

    found = extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", F.col("_text").alias("text"), F.length("_text").cast("long").alias("n_chars"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    found = scan(table(spark, sf_dir, "documents"))
    names = F.array_sort(F.array_distinct(F.transform("_matches", lambda m: m["license"])))
    return found.select("doc_id", F.size("_matches").cast("long").alias("n_matches"), F.array_join(names, ",").alias("licenses"), F.coalesce(F.array_max(F.transform("_matches", lambda m: m["containment"])), F.lit(0.0)).alias("best"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import dedup_lines

    found = dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("_n_removed").cast("long").alias("n_removed"), F.col("_n_kept").cast("long").alias("n_kept"), F.sha2(F.encode(F.coalesce("text", F.lit("")), "utf-8"), 256).alias("text_sha256"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_copies") * F.col("_size")).alias("taken"))


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lexical import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .codes import compress

    found = compress(table(spark, sf_dir, "embeddings"))
    # Sums of longs could leave 64 bits: they are made as decimals and held at the greatest long.
    per_label = found.groupBy("label").agg(F.least(F.sum(F.col("_error").cast("decimal(38,0)")), F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long").alias("label_error"))
    per_label = per_label.withColumnRenamed("label", "_label")
    joined = found.join(per_label, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", F.col("_code").alias("code"), F.col("_error").alias("error"), "label_error", F.col("_books").alias("codebooks_sha256"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    found = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", F.col("_held_out").alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.3).cast("int").alias("predicted"))


QUERIES = {f.__name__: f for f in (op1_ppm_score, op2_ngram_join, op3_language_id, op4_substring_dedup, op5_decontaminate, op6_main_text, op7_license_scan, op8_line_dedup, op9_mix_sources, op10_top_k, op11_lexical_search, op12_vector_codes, op13_toxicity)}

ORACLE_SQL: dict[str, str] = {"op2_ngram_join": oracles.OP2, "op4_substring_dedup": oracles.OP4, "op5_decontaminate": oracles.OP5, "op9_mix_sources": oracles.OP9, "op10_top_k": oracles.OP10, "op11_lexical_search": oracles.OP11, "op12_vector_codes": oracles.OP12}
