"""Aligned sequences: .loci blocks, FASTA files, NEXUS matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A record's name that ends in its locus.
MARK = r"^(.*) \[locus=([^\]]*)\]$"


def read_loci(spark: SparkSession, path: str) -> DataFrame:
    """(locus, sample, ord, seq) of a .loci file: a locus ends at a line `//...|number|`.

    The file is split at these line ends, so a row is a locus and the file can be split.
    """
    rows = spark.read.option("lineSep", "|\n").text(path).where(F.col("value").contains("//"))
    locus = F.regexp_extract("value", r"//[^|]*\|(\d+)$", 1)
    lines = rows.select(locus.alias("locus"), F.posexplode(F.split("value", "\n")).alias("ord", "line")).where(~F.col("line").startswith("//") & (F.trim("line") != ""))
    parts = F.split(F.trim("line"), r"\s+")
    return lines.select("locus", F.get(parts, F.lit(0)).alias("sample"), "ord", F.get(parts, F.lit(1)).alias("seq"))


def _records(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("lineSep", ">").text(path).select(F.col("value"), F.col("_metadata.file_name").alias("file"), F.regexp_extract("_metadata.file_path", "/locus=([^/]+)/", 1).alias("folder"))
    lines = F.filter(F.split("value", "\n"), lambda x: ~x.startswith("#") & (F.trim(x) != ""))
    rows = rows.withColumn("l", lines).where(F.size("l") > 1)
    return rows.select("file", "folder", F.trim(F.get("l", F.lit(0))).alias("name"), F.array_join(F.transform(F.slice("l", F.lit(2), F.size("l")), lambda x: F.trim(x)), "").alias("seq"))


def read_stacks_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(locus, sample, allele, seq) of records `>CLocus_N_..._Allele_k [sample]`."""
    r = _records(spark, path)
    return r.select(F.regexp_extract("name", r"CLocus_(\d+)", 1).alias("locus"), F.regexp_extract("name", r"\[([^\];]+)", 1).alias("sample"), F.regexp_extract("name", r"Allele_(\d+)", 1).cast("int").alias("allele"), "seq")


def read_alignments(spark: SparkSession, path: str) -> DataFrame:
    """(locus, sample, seq) of aligned FASTA files; codes in lower case.

    The locus is the one at the end of a record's name, as `write_fasta` writes it with `together`, else that of a folder
    `locus=...`, else the file's name.
    """
    r = _records(spark, path).withColumn("marked", F.col("name").rlike(MARK))
    place = F.when(F.col("folder") != "", F.col("folder")).otherwise(F.regexp_replace("file", r"\.[^.]*$", ""))
    part = lambda i, other: F.when(F.col("marked"), F.regexp_extract("name", MARK, i)).otherwise(other)
    return r.select(part(2, place).alias("locus"), part(1, F.col("name")).alias("sample"), F.lower("seq").alias("seq"))


def write_fasta(seqs: DataFrame, path: str, consensus: DataFrame | None = None, together: bool = False) -> None:
    """A folder of FASTA per locus; `consensus` (locus, seq) goes to one folder beside it, `<path>_consensus`.

    `together`: a file for each task instead, with many loci, each whole and in one file, and names that end in the locus:
    `>sample [locus=7]`. Meant for more than some thousand loci, as files are committed and listed one by one.
    """
    if consensus is not None:
        consensus.select(F.concat(F.lit(">"), F.col("locus").cast("string"), F.lit("\n"), "seq").alias("value"), "locus").orderBy("locus").select("value").write.mode("overwrite").text(path.rstrip("/") + "_consensus")
    if together:
        locus = F.coalesce(F.col("locus").cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))  # as the folder of null is named
        record = F.concat(F.lit(">"), "sample", F.lit(" [locus="), locus, F.lit("]\n"), "seq")
        seqs.select("locus", record.alias("value")).repartition("locus").sortWithinPartitions("locus", "value").select("value").write.mode("overwrite").text(path)
        return
    seqs.select("locus", F.concat(F.lit(">"), "sample", F.lit("\n"), "seq").alias("value")).repartition("locus").sortWithinPartitions("locus", "value").write.mode("overwrite").partitionBy("locus").text(path)


def read_nexus012(spark: SparkSession, path: str) -> DataFrame:
    """(sample, dosages) of the rows `sample<TAB>012?` of a NEXUS matrix; ? is null."""
    r = spark.read.text(path).select(F.regexp_extract("value", r"^\s*(\S+)\s+([012?]+)\s*$", 1).alias("sample"), F.regexp_extract("value", r"^\s*(\S+)\s+([012?]+)\s*$", 2).alias("s")).where("s != ''")
    return r.select("sample", F.transform(F.filter(F.split("s", ""), lambda x: x != ""), lambda x: x.try_cast("int")).alias("dosages"))
