"""A corpus, cleaned and mixed: five operators in turn over the documents table.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame.
`run` writes what a stage returns in the shared folder and reads it again for the next one.
Repeated doc_ids, nulls in any column, empty tables and further columns are the operators' matter;
each of them states its result in its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.llm.common import materialize, table
from locusframe.llm.decontaminate import contaminated_words, n_hit
from locusframe.llm.langid import identify
from locusframe.llm.lines import dedup_lines
from locusframe.llm.mixing import mix
from locusframe.llm.ngram_join import near_duplicates

#: Least pooled probability of the predicted language of a document that stays.
LEAST_LANGUAGE_SCORE = 0.4


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is clear: not `und`, and not below the least score.

    Null and empty texts, and those without a letter, go; equal texts stay or go together, whatever their ids, null ones too. No
    documents, or none with a label to learn from: no rows.
    """
    found = identify(docs)
    return found.where((F.col("_lang_pred") != "und") & (F.col("_score") >= LEAST_LANGUAGE_SCORE)).select(docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines kept elsewhere, short ones too; documents that lose lines and keep no word go; n_chars follows.

    Rows equal in doc_id and text keep the same lines; null and empty texts stay. `docs` needs a column n_chars
    besides doc_id and text. No documents: no rows.
    """
    left = dedup_lines(docs).where((F.col("_n_removed") == 0) | F.col("text").rlike(r"[\p{L}\p{N}]"))
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the smallest id, of each component of linked documents.

    Rows of one id stay or go together; rows with a null id stay.
    """
    found = near_duplicates(docs)
    gone = found.where(F.col("component_id") != F.col("doc_id")).select(F.col("doc_id").alias("gone")).distinct()
    return docs.alias("docs").join(gone.alias("by"), F.col("docs.doc_id") == F.col("by.gone"), "left_anti").select(docs.columns)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a twentieth or more of the words lies in benchmark passages.

    Rows equal in doc_id and text stay or go together; null and empty texts stay.
    """
    hit = contaminated_words(docs, table(spark, sf_dir, "benchmark")).withColumn("n_hit", n_hit())
    bad = hit.where((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).select("doc_id", "text_key").distinct()
    same = F.col("docs.doc_id").eqNullSafe(F.col("by.doc_id")) & (F.xxhash64("docs.text") == F.col("by.text_key"))
    return docs.alias("docs").join(bad.alias("by"), same, "left_anti").select([F.col(f"docs.`{c}`") for c in docs.columns])


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with their number of copies and their source's target.

    Null and empty texts have size 0; they come with their source's certain copies. Rows of one id are documents each, and equal
    rows get equal copies. A null source is a source of its own, the last one. No documents: no rows. Columns of docs named
    size, target or copies come out beside the added ones of that name.
    """
    return mix(docs).where(F.col("_copies") > 0).select(*docs.columns, F.col("_size").alias("size"), F.col("_target").alias("target"), F.col("_copies").alias("copies"))


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("ngram_join", join_stage),
    ("decontamination", benchmark_stage),
    ("mixing", mix_stage),
]

#: A recurrent network decides in the first stage, so SQL cannot give the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
