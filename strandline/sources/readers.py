"""Readers of samples, lookups, predictions and gene sets; checks fail a read instead of changing rows silently."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .sites import SITE_TYPE, attribute, parse_sites


def first_lines(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The sites among the first n lines of one file, blank lines counted."""
    return parse_sites(spark.read.text(path).limit(n))


def read_selected_sites(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Sites of ``wanted`` (transcript_id, transcript_position) only: other transcripts' lines are never parsed."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    named = lines.withColumn("transcript_id", F.substring_index(F.regexp_extract("value", r'^\s*\{\s*"([^"]+)"', 1), ".", 1))
    held = named.join(wanted.select("transcript_id").distinct(), "transcript_id", "left_semi").select("value")
    sites = parse_sites(held).withColumn("transcript_id", F.substring_index("transcript_id", ".", 1))
    return sites.join(wanted.select("transcript_id", "transcript_position").distinct(), ["transcript_id", "transcript_position"], "left_semi")


def pool_samples(spark: SparkSession, paths: list[str], wanted: DataFrame) -> DataFrame:
    """One row a wanted site with the readings of all samples, in the order of ``paths``."""
    parts = [read_selected_sites(spark, p, wanted).withColumn("_sample", F.lit(i)) for i, p in enumerate(paths)]
    whole = reduce(DataFrame.unionByName, parts)
    g = whole.groupBy("transcript_id", "transcript_position").agg(F.min_by("kmer", "_sample").alias("kmer"), F.array_sort(F.collect_list(F.struct("_sample", "reads"))).alias("_r"))
    return g.select("transcript_id", "transcript_position", "kmer", F.flatten(F.transform("_r", lambda x: x["reads"])).alias("reads")).withColumn("n_reads", F.size("reads"))


def read_info(spark: SparkSession, path: str) -> DataFrame:
    """(gene_id, transcript_id, transcript_position, label): a missing gene is an empty string, never null."""
    schema = "gene_id string, transcript_id string, transcript_position int, label int"
    rows = spark.read.csv(path, schema=schema, header=True, enforceSchema=False, mode="FAILFAST", nullValue="\u0000", emptyValue="")
    return rows.withColumn("gene_id", F.coalesce("gene_id", F.lit("")))


def read_predictions(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Predictions of shard files, with the fold that their path names (fold_3/...); broken and empty rows go.

    Copies of a key that agree are one row. Copies that differ are one row without a probability: none of them is kept by chance.
    """
    rows = spark.read.csv(paths, schema="transcript_id string, transcript_position int, probability double", header=True, mode="DROPMALFORMED")
    fold = F.regexp_extract(F.col("_metadata.file_path"), r"fold[_=-]?(\d+)", 1)
    rows = rows.select("*", F.when(fold != "", fold.cast("int")).alias("fold"))
    fine = rows.where(F.col("transcript_position").isNotNull() & F.col("probability").isNotNull() & ~F.isnan("probability"))
    once = fine.groupBy("transcript_id", "transcript_position", "fold").agg(F.min("probability").alias("_low"), F.max("probability").alias("_high"))
    return once.select("transcript_id", "transcript_position", F.when(F.col("_low") == F.col("_high"), F.col("_low")).alias("probability"), "fold")


def read_genes(spark: SparkSession, path: str) -> DataFrame:
    """(gene_id without version, gene_name, gene_type) of an annotation's genes."""
    schema = "chrom string, source string, feature string, start int, end int, score string, strand string, frame string, attributes string"
    rows = spark.read.csv(path, sep="\t", comment="#", schema=schema, quote="").where("feature = 'gene'")
    kind = F.coalesce(F.nullif(attribute("attributes", "gene_type"), F.lit("")), attribute("attributes", "gene_biotype"))
    return rows.select(F.substring_index(attribute("attributes", "gene_id"), ".", 1).alias("gene_id"), attribute("attributes", "gene_name").alias("gene_name"), kind.alias("gene_type"))


def _chromosome(name: Column) -> Column:
    short = F.regexp_replace(name, "^chr", "")
    return F.when(short == "M", "MT").otherwise(short)


def read_truth_bed(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, pos, strand, ratio) of a BED file; pos counts from 1, so it is the interval's end."""
    rows = spark.read.csv(path, sep="\t", comment="#", schema="chrom string, start int, pos int, name string, ratio double, strand string")
    return rows.select(_chromosome(F.col("chrom")).alias("chrom"), "pos", "strand", "ratio")


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """(transcript_id without version, transcript_position, n_reads) of a headed file, whatever its columns are called."""
    rows = spark.read.csv(path, header=True, inferSchema=False)
    t, p, n = rows.columns[:3]
    return rows.select(F.substring_index(F.col(t), ".", 1).alias("transcript_id"), F.col(p).cast("int").alias("transcript_position"), F.col(n).cast("long").alias("n_reads"))


def read_gene_sets(spark: SparkSession, path: str, genes: DataFrame) -> DataFrame:
    """(set_name, gene_id) of a tab-separated list of sets (name, address, members by gene name); of genes with one name the first id counts."""
    parts = F.split("value", "\t")
    members = spark.read.text(path).select(parts[0].alias("set_name"), F.explode(F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0)))).alias("gene_name"))
    once = genes.groupBy("gene_name").agg(F.min("gene_id").alias("gene_id"))
    return members.where(F.trim("gene_name") != "").join(once, "gene_name").select("set_name", "gene_id").distinct()


def ribosomal(gene_name: Column) -> Column:
    """Names of ribosomal proteins."""
    return gene_name.rlike(r"^(RPL|RPS|MRPL|MRPS)\d")


def read_shards(spark: SparkSession, path: str, shards: list[str] | None = None) -> DataFrame:
    """Records of a sharded export, of the named shards only: others are not opened."""
    rows = spark.read.json(path)
    return rows if shards is None else rows.where(F.col("shard").cast("string").isin(shards))


def read_checked_scores(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Scores whose k-mers, numbers and keys are checked while they are read; the first bad row fails the read."""
    rows = spark.read.csv(path, header=True)
    missing = [c for c in (*keys, "kmer", "score", "rank") if c not in rows.columns]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    score, rank = (F.col(c).try_cast("double") for c in ("score", "rank"))
    copies = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    problem = (
        F.when(~F.coalesce(F.col("kmer").rlike("^[ACGT]{7}$"), F.lit(False)), "a k-mer does not have 7 bases")
        .when(score.isNull() | F.isnan(score) | (F.abs(score) == float("inf")), "a score is not finite")
        .when(rank.isNull() | (rank < 0) | (rank > 1), "a rank is not within 0 and 1")
        .when(F.col("_copies") > 1, "a key occurs twice")
    )
    checked = rows.withColumn("_copies", copies).withColumn("kmer", F.when(problem.isNull(), F.col("kmer")).otherwise(F.raise_error(F.coalesce(problem, F.lit("")))))
    return checked.select(*keys, "kmer", score.alias("score"), rank.alias("rank"))


def all_site_counts(lines: DataFrame, column: str = "value") -> DataFrame:
    """(transcript_id, transcript_position, kmer, n_reads) of every key of every line, not of the first alone."""
    t = lines.where(F.trim(column) != "").select(F.explode(F.from_json(column, SITE_TYPE)).alias("transcript_id", "_p"))
    p = t.select("transcript_id", F.explode("_p").alias("transcript_position", "_k"))
    return p.select("transcript_id", F.col("transcript_position").cast("int"), F.explode("_k").alias("kmer", "_r")).select("transcript_id", "transcript_position", "kmer", F.size("_r").alias("n_reads"))
