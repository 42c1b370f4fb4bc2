"""Writers: offset-indexed records, sharded exports, scores and their validation."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.tables import saved
from ..operators.windows import numbered, running_sums


def offset_index(lines: DataFrame, order: str, line: str) -> DataFrame:
    """Adds start and end: byte offsets of each line (with its newline) in the file that holds them in order.

    ``order`` is unique. Two levels, so that no task holds all lines: sums over ranges of it, then running sums inside each.
    """
    sized = lines.select(order, (F.octet_length(line) + 1).cast("long").alias("_size"))
    ends = running_sums(sized, [], order, {"_size": "end"}).withColumn("start", F.col("end") - F.col("_size")).drop("_size")
    return lines.join(ends, order)


def write_scores(df: DataFrame, path: str) -> None:
    df.select("transcript_id", "transcript_position", "score").write.mode("overwrite").csv(path, header=True)


def write_sharded(df: DataFrame, path: str, shard: str) -> None:
    df.repartition(shard).write.mode("overwrite").partitionBy(shard).json(path, compression="gzip")


def submission_problems(scores: DataFrame, expected: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """Counts of problems by kind: not_numeric, out_of_range, duplicate, missing, extra."""
    s = F.try_to_number(F.col(score).cast("string"), F.lit("9.999999999")) if dict(scores.dtypes)[score] == "string" else F.col(score)
    rows = scores.withColumn("_s", s.cast("double"))
    counts = rows.agg(
        F.count_if(F.col("_s").isNull()).alias("not_numeric"), F.count_if((F.col("_s") < 0) | (F.col("_s") > 1)).alias("out_of_range")
    )
    kinds = counts.selectExpr("stack(2, 'not_numeric', not_numeric, 'out_of_range', out_of_range) as (kind, n)")
    copies = rows.groupBy(*keys).count().where("count > 1").agg(F.count(F.lit(1)).alias("n")).select(F.lit("duplicate").alias("kind"), "n")
    missing = expected.select(*keys).distinct().join(rows, keys, "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("missing").alias("kind"), "n")
    extra = rows.select(*keys).distinct().join(expected, keys, "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("extra").alias("kind"), "n")
    return kinds.unionByName(copies).unionByName(missing).unionByName(extra)


def write_indexed(lines: DataFrame, path: str, order: str, line: str, keys: list[str]) -> None:
    """``path``/data as text in order and ``path``/info as csv of the keys and each line's byte offsets in the joined files."""
    indexed = offset_index(lines, order, line)
    indexed.repartitionByRange(order).sortWithinPartitions(order).select(line).write.mode("overwrite").text(f"{path}/data")
    indexed.select(*keys, "start", "end").write.mode("overwrite").csv(f"{path}/info", header=True)


def write_folds(rows: DataFrame, folds: DataFrame, path: str, group: str, seed: str = "validation") -> None:
    """Rows by fold and part: a fold's groups are its test part, a tenth of the others its validation part, chosen by group."""
    numbers = folds.select(F.col("fold").alias("fold")).distinct()  # a handful of folds
    parts = rows.join(folds.select(group, F.col("fold").alias("_own")), group).join(F.broadcast(numbers), how="cross")
    tenth = F.substring(F.md5(F.concat_ws(":", F.lit(seed), "fold", F.col(group).cast("string"))), 1, 8) < f"{int(0.1 * (1 << 32)):08x}"
    part = F.when(F.col("_own") == F.col("fold"), "test").when(tenth, "validation").otherwise("train")
    parts.withColumn("part", part).drop("_own").write.mode("overwrite").partitionBy("fold", "part").csv(path, header=True)


def write_by_name(rows: DataFrame, path: str, keys: list[str], columns: list[str], digits: int = 24) -> DataFrame:
    """One JSON record a key in a folder named by its hash, or by the first ``digits`` of it; returns (keys, name), the index."""
    name = F.substring(F.sha2(F.concat_ws(":", *keys), 256), 1, 24)
    records = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("sites")).withColumn("name", name)
    records.withColumn("name", F.substring("name", 1, digits)).repartition("name").write.mode("overwrite").partitionBy("name").json(path)
    return records.select(*keys, "name")


def write_scored_sample(scores: DataFrame, reads: DataFrame, path: str, keys: list[str], shown: DataFrame) -> bool:
    """Scores with five digits and the readings of the shown keys; False, with nothing written, where the target exists."""
    try:
        if not scores.sparkSession.read.text(f"{path}/scores").isEmpty():
            return False
    except Exception as e:  # only a missing target is written
        if "PATH_NOT_FOUND" not in str(e):
            raise
    digits = F.format_string("%.5g", F.col("score").cast("double"))
    scores.withColumn("score", digits).write.csv(f"{path}/scores", header=True)
    reads.join(shown.select(*keys).distinct(), keys, "left_semi").write.parquet(f"{path}/reads")
    return True


def write_sample(lines: DataFrame, path: str, n: int, key: str, line: str, seed: str = "sample") -> None:
    """Exactly n lines (all if there are fewer), those of the smallest keyed hashes, as one gzip text."""
    draw = F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")))
    lines.orderBy(draw, key).limit(n).orderBy(key).coalesce(1).select(line).write.mode("overwrite").text(path, compression="gzip")


def write_ranked(rows: DataFrame, path: str, order: list[str], kmer: str = "kmer") -> None:
    """Rows in order as quoted csv with a header, bases of RNA, quotes doubled, lines ended by CR LF.

    The files in the order of their names, joined, are one csv; the header is in the first of them that has lines.
    """
    rna = rows.withColumn(kmer, F.translate(kmer, "T", "U")) if kmer in rows.columns else rows

    def quoted(c: Column) -> Column:
        return F.concat(F.lit('"'), F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))

    lines = numbered(rna, [], [F.asc(c) for c in order], "_at").select("_at", F.concat_ws(",", *[quoted(F.col(c)) for c in rows.columns]).alias("value"))
    header = rows.sparkSession.createDataFrame([(-1, ",".join(f'"{c}"' for c in rows.columns))], "_at long, value string")
    lines.unionByName(header).repartitionByRange("_at").sortWithinPartitions("_at").select("value").write.mode("overwrite").option("lineSep", "\r\n").text(path)


def gene_records(sites: DataFrame, batches: DataFrame, first: int = 5) -> DataFrame:
    """One nested record a gene: its sites in order, and for each line the sites' ranks, depths and their places in the batches.

    ``sites`` have line, gene, pos, kmer, region, tx, rank (0 to 1) and n_reads; ``batches`` line, batch, gene, pos and
    rank. Ranks are whole numbers up to 9999, -1 where a batch has no rank. ``holds`` counts the batches in which a site is
    among its gene's ``first`` sites. A gene's sites are as many as its transcripts have candidates. Both tables are moved
    once, by gene; what follows, and the record itself, is the gene's.
    """
    known = F.col("line").isNotNull() & F.col("gene").isNotNull() & F.col("pos").isNotNull()
    both = sites.withColumn("_site", F.lit(True)).unionByName(batches.where(known).select("line", "batch", "gene", "pos", "rank").withColumn("_site", F.lit(False)), allowMissingColumns=True)
    moved = both.repartition("gene")
    place = Window.partitionBy("gene", "line", "batch", "_site").orderBy(F.desc("rank"), "pos")
    whole = F.coalesce(F.round(F.col("rank") * 9999).cast("int"), F.lit(-1))
    placed = moved.select("line", "gene", "pos", "batch", "rank", "n_reads", "_site", F.when(F.col("rank").isNotNull(), F.row_number().over(place)).alias("_place"), whole.alias("_r"))
    mine, theirs = F.col("_site"), ~F.col("_site")
    merged = placed.groupBy("gene", "line", "pos").agg(
        F.max(F.when(mine, F.col("rank"))).alias("rank"), F.sum(F.when(mine, F.col("n_reads"))).alias("n"), F.max("_site").alias("_held"),
        F.array_sort(F.collect_list(F.when(theirs, F.struct("batch", F.col("_r").alias("r"))))).alias("batches"), F.count_if(theirs & (F.col("_place") <= first)).cast("int").alias("holds"),
    )
    fixed = moved.where("_site").groupBy("gene", "pos").agg(F.min("kmer").alias("kmer"), F.mode("region", True).alias("region"), F.array_sort(F.collect_set("tx")).alias("tx"))
    row = F.struct("pos", whole.alias("r"), "n", "batches", "holds")
    lines = merged.where("_held").groupBy("gene", "line").agg(F.array_sort(F.collect_list(row)).alias("sites"))
    lines = lines.groupBy("gene").agg(F.array_sort(F.collect_list(F.struct("line", "sites"))).alias("lines"))
    listed = fixed.groupBy("gene").agg(F.array_sort(F.collect_list(F.struct("pos", "kmer", "region", "tx"))).alias("sites"))
    return listed.join(lines, "gene", "left")


def write_export(records: DataFrame, path: str, shards: int) -> None:
    """``path``/shards/shard=n/*.json.gz and ``path``/genes: each gene's shard, number of sites and best rank by line.

    Everything is written beside the target and then moved in one step, so a reader sees the whole export or none. An
    existing target is an error.
    """
    spark = records.sparkSession
    part = f"{path.rstrip('/')}.part-{uuid.uuid4().hex}"
    held = saved(records.withColumn("shard", F.pmod(F.xxhash64("gene"), F.lit(shards)).cast("int")), "gene-records")
    held.repartition("shard").write.partitionBy("shard").json(f"{part}/shards", compression="gzip")
    best = F.transform("lines", lambda x: F.struct(x["line"].alias("line"), F.size(x["sites"]).alias("n"), F.array_max(F.transform(x["sites"], lambda s: s["r"])).alias("best")))
    held.select("gene", "shard", best.alias("lines")).write.json(f"{part}/genes", compression="gzip")
    old, new = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (part, path))
    files = old.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(new) or not files.rename(old, new):
        raise FileExistsError(path)
