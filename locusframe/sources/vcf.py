"""VCF text and the small files beside it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import genotype as G
from . import blocks
from .shared import remove, shared_path
from .sides import small_side

FIXED = ("chrom", "pos", "id", "ref", "alt", "qual", "filter", "info", "format")


def parse_lines(lines: DataFrame) -> DataFrame:
    """Packed sites of VCF rows (value), with the columns that the lines carry besides.

    Columns: chrom, locus, pos, snp_id, alleles, qual, filter, info (map), format, calls (array of
    gt, phased, dp, pl), and raw (the text of each call) and info_text, with which `to_lines` writes
    what was read. Missing numbers are null.
    """
    rows = lines.where(~F.col("value").startswith("#") & (F.trim("value") != "")).withColumn("f", F.split("value", r"\s+"))
    fmt = F.split(F.get("f", F.lit(8)), ":")
    # Places of fields are looked up once for each row, and a call is cut into its fields once.
    field = lambda parts, place: F.when(F.col(place) > 0, F.get(parts, F.col(place) - 1))
    pl = lambda parts: F.transform(F.split(field(parts, "_pl"), ","), lambda x: G.number_of(x, "double"))
    gt = lambda parts: F.get(parts, F.lit(0))
    call = lambda parts: F.struct(G.gt_alleles(gt(parts)).alias("gt"), gt(parts).contains("|").alias("phased"), G.number_of(field(parts, "_dp"), "int").alias("dp"), pl(parts).alias("pl"))
    at = lambda i: F.get("f", F.lit(i))
    keep = [c for c in lines.columns if c != "value"]
    head = rows.select(*keep, at(0).alias("chrom"), at(1).cast("long").alias("pos"), at(2).alias("snp_id"), F.concat(F.array(at(3)), F.split(at(4), ",")).alias("alleles"), at(5).alias("qual"), at(6).alias("filter"),
                       F.str_to_map(at(7), F.lit(";"), F.lit("=")).alias("info"), at(7).alias("info_text"), fmt.alias("format"), F.slice("f", F.lit(10), F.size("f")).alias("raw"))
    placed = head.withColumns({f"_{k.lower()}": F.array_position("format", k).cast("int") for k in ("DP", "PL")})
    parsed = F.transform(F.transform("raw", lambda c: F.split(c, ":")), call)
    return placed.withColumn("locus", F.col("chrom")).withColumn("calls", parsed).drop("_dp", "_pl")


def read_vcf(spark: SparkSession, path: str, split: int = blocks.SPLIT) -> tuple[DataFrame, list[str]]:
    """(packed sites, sample names). site_id numbers the rows in the order of the files and their lines.

    Numbers come from the counts of the parts in which the files are read. Block-compressed files are
    read in parts of `split` of their bytes, by a task each as far as `blocks.TASKS` goes. Other compressed files, and those in file systems that
    only Spark can open, are read by one task each; their rows are dealt out after they were numbered.
    """
    lines = spark.read.text(path)
    files = lines.inputFiles()
    in_blocks = blocks.is_compressed(files)
    if in_blocks:
        lines = blocks.read_lines(spark, files, split)
        part = F.struct("file", "start")
    else:
        part = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    head = lines.where(F.col("value").startswith("#CHROM")).first()
    names = head["value"].split()[9:] if head else []
    rows = lines.where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    # A part of a file, and the place of a row in it: rows of a part are read in their order.
    rows = rows.select("value", part.alias("part"), F.monotonically_increasing_id().alias("at"))
    sizes = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = sizes.select("part", "first", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))  # one row for each part of a file
    numbered = rows.join(F.broadcast(before), "part").select("value", (F.col("before") + F.col("at") - F.col("first")).alias("site_id"))
    if any(f.endswith((".gz", ".bgz")) for f in files) and not (in_blocks and blocks.has_blocks(files[0])):
        numbered = numbered.repartition(spark.sparkContext.defaultParallelism)
    return parse_lines(numbered), names


def read_sweep(spark: SparkSession, files: list[tuple[str, str]]) -> tuple[DataFrame, dict[str, list[str]]]:
    """Sites of several (parameter value, path), tagged by `param`, and the sample names of each."""
    read = [(p, *read_vcf(spark, path)) for p, path in files]
    tagged = [sites.withColumn("param", F.lit(p)) for p, sites, _ in read]
    return reduce(DataFrame.unionByName, tagged), {p: names for p, _, names in read}


def require_ns(sites: DataFrame) -> DataFrame:
    """Adds ns from INFO (NS, else AN); a site with neither raises an error when it is read."""
    ns = G.info_number(F.col("info"))
    return sites.withColumn("ns", F.coalesce(ns, F.raise_error(F.concat(F.lit("neither NS nor AN at "), "snp_id")).cast("int")))


def to_lines(sites: DataFrame, *order: str, sort: bool = True) -> DataFrame:
    """Rows of VCF text in the given order; with `sort` off, next to the columns of the order, but as they come.

    Sites that were read (with raw and info_text) come out as they were, all fields of FORMAT and INFO
    in their order; of a call that was masked since, only the genotype becomes missing. Other sites get
    GT and DP. PL is written where FORMAT has it and the text had not. A missing depth is a dot.
    """
    sep = lambda c: F.when(F.coalesce(c["phased"], F.lit(False)), "|").otherwise("/")
    gt = lambda c: F.call_function("array_join", F.transform(c["gt"], lambda a: a.cast("string")), sep(c), F.lit("."))
    pl = lambda c: F.coalesce(F.array_join(F.transform(c["pl"], lambda x: x.cast("string")), ","), F.lit("."))
    has_pl = F.array_contains("format", "PL")
    if "raw" in sites.columns:
        # A call shorter than FORMAT has lost trailing fields; new PL goes to the end, after dots for those.
        fields = lambda t: F.split(t, ":")
        longer = lambda t: F.concat(fields(t), F.array_repeat(F.lit("."), F.greatest(F.lit(0), F.size("format") - 1 - F.size(fields(t)))))
        masked = lambda c, t: F.when(~G.is_called(c["gt"]) & G.is_called(G.parse_gt(t)), F.regexp_replace(t, r"^[^:]*", gt(c))).otherwise(t)
        new_pl = has_pl & ~F.col("_pl_read")
        with_pl = lambda c, i: F.concat_ws(":", longer(masked(c, F.get("raw", i))), pl(c))
        # PL was read if a call's text has as many fields as FORMAT.
        sites = sites.withColumn("_pl_read", F.coalesce(F.exists("raw", lambda t: F.size(F.split(t, ":")) >= F.size("format")), F.lit(False)))
        calls = F.when(new_pl, F.transform("calls", with_pl)).otherwise(F.transform("calls", lambda c, i: masked(c, F.get("raw", i))))
        info, fmt = F.col("info_text"), F.array_join("format", ":")
    else:
        call = lambda c: F.concat_ws(":", gt(c), F.coalesce(c["dp"].cast("string"), F.lit(".")), F.when(has_pl, pl(c)))
        info = F.array_join(F.transform(F.array_sort(F.map_entries("info")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
        calls, fmt = F.transform("calls", call), F.when(has_pl, "GT:DP:PL").otherwise("GT:DP")
    alleles = (F.get("alleles", F.lit(0)), F.array_join(F.slice("alleles", F.lit(2), F.size("alleles")), ","))
    line = F.concat_ws("\t", "chrom", F.col("pos").cast("string"), "snp_id", *alleles, "qual", "filter", info, fmt, F.array_join(calls, "\t"))
    lines = sites.select(*order, line.alias("value"))
    return lines.orderBy(*order) if order and sort else lines


def write_vcf(sites: DataFrame, samples: list[str], path: str, *order: str, meta: tuple[str, ...] = ("##fileformat=VCFv4.2",), compress: bool = False) -> None:
    """A folder of text, or of block-compressed text: the header, then the rows, by default in the order of site_id.

    Header and rows are dealt out by range together, so the header opens the first file and files sort
    in the order of their rows. Sorting reads its input twice, so the rows are made once, in a table of the
    shared folder that is removed at the end.
    """
    spark = sites.sparkSession
    order = order or (("site_id",) if "site_id" in sites.columns else ())
    top = [*meta, "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *samples])]
    head = spark.createDataFrame(list(enumerate(top, -len(top))), "_h long, value string")
    for c in order:
        head = head.withColumn(c, F.lit(None).cast(sites.schema[c].dataType))
    made, unsorted = to_lines(sites, *order, sort=False), shared_path(spark)
    made.write.parquet(unsorted)
    rows = spark.read.schema(made.schema).parquet(unsorted).withColumn("_h", F.lit(0).cast("long"))
    lines = head.unionByName(rows).orderBy("_h", *order).select("value")
    if compress and blocks.can_open(path):
        blocks.write_lines(lines, path)
    else:  # where only Spark can open the folder, plain gzip
        lines.write.mode("overwrite").text(path, compression="gzip" if compress else None)
    remove(spark, unsorted)


def add_pl(sites: DataFrame) -> DataFrame:
    """FORMAT and calls with PL of zeros."""
    zero = F.array(*[F.lit(0.0)] * 3)
    return sites.withColumn("format", F.array_append("format", F.lit("PL"))).withColumn("calls", F.transform("calls", lambda c: c.withField("pl", zero)))


PL_META = '##FORMAT=<ID=PL,Number=G,Type=Float,Description="Phred-scaled genotype likelihoods">'


def read_samples(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Headerless tab-separated table; text columns but lat and lon."""
    schema = ", ".join(f"{c} {'double' if c in ('lat', 'lon') else 'string'}" for c in columns or ("sample", "pop"))
    return spark.read.csv(path, sep="\t", schema=schema)


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """One id per line; empty lines do not count."""
    return spark.read.text(path).select(F.rtrim("value").alias("id")).where("id != ''")


def require_samples(names: DataFrame, table: DataFrame) -> DataFrame:
    """`names` (sample) with the table's columns; an error if one of them is not in it."""
    lost = names.join(table, "sample", "left_anti").limit(5).collect()
    if lost:
        raise ValueError("samples without an entry: " + ", ".join(r["sample"] for r in lost))
    return names.join(small_side(table), "sample")


def unmatched(names: DataFrame, table: DataFrame) -> DataFrame:
    """Samples that one of two tables lacks: (sample, missing_from)."""
    a = names.select("sample").join(table, "sample", "left_anti").select("sample", F.lit("table").alias("missing_from"))
    return a.unionByName(table.select("sample").join(names, "sample", "left_anti").select("sample", F.lit("data").alias("missing_from")))
