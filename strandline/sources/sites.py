"""Readers of nested site records, labels, annotation and sequence files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The type of one line: transcript, position, k-mer, readings of nine numbers.
SITE_TYPE = "map<string,map<string,map<string,array<array<float>>>>>"
READ_COLUMNS = ("dwell_m1", "sd_m1", "mean_m1", "dwell_0", "sd_0", "mean_0", "dwell_p1", "sd_p1", "mean_p1")
MOTIF = "^[AGT][AG]AC[ACT]$"


def parse_sites(lines: DataFrame, column: str = "value", width: int = 9) -> DataFrame:
    """Sites of JSON lines: the first key of each level; blank lines are skipped, readings of another width fail."""
    # Spark's JSON parser keeps a table of field names and copies it for every name it has not met, so a transcript's
    # name is taken out of the line before; a line of another form, or a name with escapes, is parsed as it is
    cut = lines.where(F.trim(column) != "").select(column, F.split(column, '"', 3).alias("_cut"))
    head, name, rest = (F.get("_cut", F.lit(i)) for i in range(3))
    plain = (F.trim(head) == "{") & ~name.rlike(r"[\\\x00-\x1f]") & rest.isNotNull()
    line = F.when(plain, F.concat(F.lit('{""'), rest)).otherwise(F.col(column))

    def site(t: Column) -> Column:
        p = F.map_values(t)[0]
        k = F.map_values(p)[0]
        reads = F.map_values(k)[0]
        fits = F.when(F.forall(reads, lambda r: F.size(r) == width), reads).otherwise(F.raise_error(F.lit(f"a reading does not have {width} values")))
        transcript = F.coalesce(F.when(plain, name), F.map_keys(t)[0]).alias("transcript_id")
        return F.struct(transcript, F.map_keys(p)[0].cast("int").alias("transcript_position"), F.map_keys(k)[0].alias("kmer"), fits.alias("reads"))

    # a one-row explode keeps the optimizer from copying the parse into every later filter and column; only the site's
    # own values are in its row, not the parser's maps
    out = cut.select(F.inline(F.transform(F.array(F.from_json(line, SITE_TYPE)), site)))
    return out.withColumn("n_reads", F.size("reads")).withColumn("motif", F.substring("kmer", 2, 5))


def read_sites(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Sites of a text or gzip file; a gzip file is one task until it is dealt out by transcript."""
    sites = parse_sites(spark.read.text(path))
    return sites if partitions is None else sites.repartition(partitions, "transcript_id")


def explode_reads(sites: DataFrame) -> DataFrame:
    """One row per reading with the nine named columns."""
    rows = sites.select("transcript_id", "transcript_position", F.posexplode("reads").alias("read_no", "r"))
    return rows.select("transcript_id", "transcript_position", "read_no", *[F.col("r")[i].alias(c) for i, c in enumerate(READ_COLUMNS)])


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    schema = "gene_id string, transcript_id string, transcript_position int, label int"
    return spark.read.csv(path, schema=schema, header=True, enforceSchema=False, mode="FAILFAST")


def attribute(column: str, key: str) -> Column:
    """The value of ``key "value"`` in an annotation's attributes."""
    return F.regexp_extract(column, rf'{key} "([^"]*)"', 1)


def read_annotation(spark: SparkSession, path: str, features: list[str]) -> DataFrame:
    schema = "chrom string, source string, feature string, start int, end int, score string, strand string, frame string, attributes string"
    rows = spark.read.csv(path, sep="\t", comment="#", schema=schema, quote="").where(F.col("feature").isin(features))
    return rows.select("chrom", "feature", "start", "end", "strand", attribute("attributes", "transcript_id").alias("transcript_id"), attribute("attributes", "gene_id").alias("gene_id"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(transcript_id without version, seq)."""
    records = spark.read.text(path, lineSep=">").where(F.trim("value") != "")
    parts = F.split("value", "\n", 2)
    return records.select(
        F.substring_index(F.regexp_extract(parts[0], r"^(\S+)", 1), ".", 1).alias("transcript_id"), F.regexp_replace(parts[1], r"\s", "").alias("seq")
    )


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """External truth rows (chrom, pos, strand, ratio); chr is cut off and M is MT."""
    rows = spark.read.csv(path, header=True, schema="chrom string, pos int, strand string, ratio double")
    name = F.regexp_replace("chrom", "^chr", "")
    return rows.withColumn("chrom", F.when(name == "M", "MT").otherwise(name))
