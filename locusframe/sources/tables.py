"""Matrices, pair tables, DArT tables, vcftools tables, assembly statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .sides import small_side


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Pair table (a, b, dist) of a labelled space-delimited matrix: square or a triangle.

    Both directions, no diagonal, NA left out; of two given values of a pair the first direction's. The
    header may name the column of labels, as `write_matrix` does, and stand in each of several files.
    """
    rows = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("f"))
    head = rows.first()["f"]
    corner = rows.where(F.size("f") == len(head)).limit(2).count() == 2 and rows.where((F.size("f") == len(head)) & (F.col("f") != F.array(*map(F.lit, head)))).limit(1).count() == 1
    names = F.array(*map(F.lit, head[1:] if corner else head))
    cells = rows.where(F.size("f") > 1).where(F.col("f") != F.array(*map(F.lit, head)))
    long = cells.select(F.translate(F.get("f", F.lit(0)), '"', "").alias("a"), F.posexplode(F.slice("f", F.lit(2), F.size("f"))).alias("i", "v"))
    one = long.select("a", F.translate(F.get(names, F.col("i")), '"', "").alias("b"), F.col("v").try_cast("double").alias("dist")).where("dist is not null and a != b")
    both = one.withColumn("d", F.lit(0)).unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "dist", F.lit(1).alias("d")))
    return both.groupBy("a", "b").agg(F.min_by("dist", "d").alias("dist"))


def to_matrix(pairs: DataFrame, order: list[str]) -> DataFrame:
    """Wide square matrix: a and one column per name, null on the diagonal."""
    both = pairs.select("a", "b", "dist").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "dist")).distinct()
    return both.groupBy("a").pivot("b", order).agg(F.first("dist"))


def write_matrix(pairs: DataFrame, order: list[str], path: str) -> None:
    to_matrix(pairs, order).orderBy("a").write.mode("overwrite").csv(path, sep=" ", header=True, nullValue="NA")


def pair_lines(pairs: DataFrame) -> DataFrame:
    """Lines a, b, distance with 8 decimals, greatest distance first."""
    return pairs.orderBy(F.desc("dist"), "a", "b").select(F.format_string("%s\t%s\t%.8f", "a", "b", "dist").alias("value"))


def write_pairs(pairs: DataFrame, path: str) -> None:
    pair_lines(pairs).write.mode("overwrite").text(path)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="a string, b string, dist double")


def read_dart(spark: SparkSession, snps: str, meta: str, allele_id: str = "AlleleID") -> DataFrame:
    """(snp, sample, pop, lat, lon, dosage) of a two-row table: each SNP has rows of its two alleles.

    1/0 is 0, 1/1 is 1, 0/1 is 2, - is missing (no row). Samples without metadata and sites without
    variation are left out. Rows of a SNP are told apart by their base change: the reference row has
    none (an empty SNP column).
    """
    wide = spark.read.csv(snps, header=True)
    people = spark.read.csv(meta, header=True, schema="id string, pop string, lat double, lon double")
    names = {r["id"] for r in people.select("id").collect()}  # as many as the file has columns
    own = [c for c in wide.columns if c in names]
    ref = F.coalesce(F.trim("SNP"), F.lit("")) == ""
    long = wide.withColumn("ref", ref).withColumn("snp", F.regexp_extract(allele_id, r"^[^|]*", 0)).select("snp", "ref", *[F.col(f"`{c}`") for c in own]).unpivot(["snp", "ref"], own, "sample", "v")
    got = long.groupBy("snp", "sample").agg(F.max(F.when(F.col("ref"), F.col("v").try_cast("int"))).alias("r"), F.max(F.when(~F.col("ref"), F.col("v").try_cast("int"))).alias("s"))
    dosage = F.when((F.col("r") == 1) & (F.col("s") == 0), 0).when((F.col("r") == 1) & (F.col("s") == 1), 1).when((F.col("r") == 0) & (F.col("s") == 1), 2)
    coded = got.withColumn("dosage", dosage).where("dosage is not null")
    varies = coded.groupBy("snp").agg(F.countDistinct("dosage").alias("k")).where("k > 1").select("snp")
    return coded.join(varies, "snp", "left_semi").join(small_side(people), F.col("sample") == F.col("id")).select("snp", "sample", "pop", "lat", "lon", "dosage")


def _white(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, inferSchema=False)


def read_vcftools_tables(spark: SparkSession, prefix: str) -> tuple[DataFrame, DataFrame]:
    """(individuals, sites): .idepth, .imiss and .het joined on INDV; .ldepth.mean and .lmiss on CHR and POS."""
    indv = reduce(lambda a, b: a.join(b, "INDV"), [
        _white(spark, f"{prefix}.idepth").select("INDV", F.col("MEAN_DEPTH").cast("double").alias("mean_depth")),
        _white(spark, f"{prefix}.imiss").select("INDV", F.col("F_MISS").cast("double").alias("f_miss")),
        _white(spark, f"{prefix}.het").select("INDV", F.col("F").cast("double").alias("f")),
    ])
    depth = _white(spark, f"{prefix}.ldepth.mean").select(F.col("CHROM").alias("chrom"), F.col("POS").cast("long").alias("pos"), F.col("MEAN_DEPTH").cast("double").alias("mean_depth"))
    miss = _white(spark, f"{prefix}.lmiss").select(F.col("CHR").alias("chrom"), F.col("POS").cast("long").alias("pos"), F.col("F_MISS").cast("double").alias("f_miss"))
    return indv, depth.join(miss, ["chrom", "pos"])


def read_stats(spark: SparkSession, paths: str | list[str], param: str = r"clust_([^/_]+)") -> DataFrame:
    """(param, file, section, name, column, value) of statistics files in sections: one row for each number.

    A line of # names a section. A line that begins with white space and whose first word is no number is the head of a
    table: its words name the columns. A later line that has a name and one number more than the head, or as
    many as it has words, is a row of the table. Lines `name: text` give the last number in brackets, or at their end, under no column. What is
    above carries forward over a file's lines in their order, also where the file is read in several parts.
    `param` is taken out of the path. Other lines are left out.
    """
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at"))
    word = F.filter(F.split(F.trim("value"), r"\s+"), lambda w: w != "")
    first = F.get(word, F.lit(0))
    section = F.when(F.col("value").startswith("#"), F.trim(F.regexp_replace("value", "^#+", "")))
    head = F.when(F.col("value").rlike(r"^\s+\S") & first.try_cast("double").isNull(), word)
    # A section starts without a head, so that no table reaches into the next section.
    mark = F.when(section.isNotNull(), F.array().cast("array<string>")).otherwise(head)
    order = W.partitionBy("file").orderBy("_start", "_at").rowsBetween(W.unboundedPreceding, 0)
    seen = lines.select("file", "value", "_start", "_at", word.alias("w"), section.alias("s"), mark.alias("h"))
    seen = seen.withColumn("section", F.last("s", True).over(order)).withColumn("head", F.last("h", True).over(order)).where("s is null and h is null")
    cells = F.slice("w", F.lit(2), F.size("w"))
    names = F.when(F.size("head") == F.size("w"), F.slice("head", F.lit(2), F.size("head"))).when(F.size("head") == F.size("w") - 1, F.col("head"))
    table = seen.where((F.size("w") > 1) & names.isNotNull() & (F.size("head") > 0)).select("file", "section", F.get("w", F.lit(0)).alias("name"), F.explode(F.arrays_zip(names.alias("c"), cells.alias("v"))).alias("x"))
    table = table.select("file", "section", "name", F.col("x.c").alias("column"), F.col("x.v").try_cast("double").alias("value"))
    number = F.coalesce(F.regexp_extract("value", r"\([^)]*?([-+0-9.eE]+)\s*\)", 1).try_cast("double"), F.regexp_extract("value", r"([-+0-9.eE]+)\s*$", 1).try_cast("double"))
    plain = seen.where(F.col("value").rlike(r"^\S[^:]*:.*[0-9]")).select("file", "section", F.trim(F.regexp_extract("value", "^([^:]+):", 1)).alias("name"), F.lit(None).cast("string").alias("column"), number.alias("value"))
    got = table.unionByName(plain).where("value is not null")
    return got.select(F.regexp_extract("file", param, 1).alias("param"), "file", "section", "name", "column", "value")


def assembly_summary(stats: DataFrame) -> DataFrame:
    """One row per parameter: flagged and kept loci of the filter of shared heterozygosity, their quotient (paralogs), loci in all, and SNPs."""
    row = lambda name, column: F.max(F.when((F.col("name") == name) & F.col("column").eqNullSafe(F.lit(column)), F.col("value")))
    shared = F.col("name").contains("max_shared_het")
    got = stats.groupBy("param").agg(
        F.max(F.when(shared & (F.col("column") == "applied_order"), F.col("value"))).alias("flagged"), F.max(F.when(shared & (F.col("column") == "retained_loci"), F.col("value"))).alias("retained"),
        row("total_filtered_loci", "retained_loci").alias("loci"), row("snps matrix size", None).alias("snps"),
    )
    return got.select("param", "flagged", "retained", (F.col("flagged") / F.nullif("retained", F.lit(0.0))).alias("paralogs"), "loci", "snps")


def assembly_by_sample(stats: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """One row per parameter and sample: clusters, those over the number of alleles, their quotient (paralogs), heterozygosity and sequencing error, by the columns' names.

    `samples` (sample): only these, where given.
    """
    at = lambda column: F.max(F.when(F.col("column") == column, F.col("value")))
    known = stats.where(F.col("column").isin("clusters_total", "filtered_by_maxAlleles", "heterozygosity", "error_est"))
    if samples is not None:
        known = known.join(small_side(samples.select(F.col("sample").alias("name")).distinct()), "name", "left_semi")
    got = known.groupBy("param", F.col("name").alias("sample")).agg(at("clusters_total").alias("clusters"), at("filtered_by_maxAlleles").alias("over"), at("heterozygosity").alias("heterozygosity"), at("error_est").alias("error"))
    return got.withColumn("paralogs", F.col("over") / F.nullif("clusters", F.lit(0.0)))


def save_stage(df: DataFrame, path: str) -> DataFrame:
    """A named stage written as Parquet and read again, for later analyses."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def append_results(df: DataFrame, path: str) -> None:
    """Results of one parameter added to a table partitioned by parameter."""
    df.write.mode("append").partitionBy("param").parquet(path)
