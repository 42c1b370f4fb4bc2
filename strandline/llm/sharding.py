"""Sharding by extendible hashing, DataFrame operations only.

A directory is indexed by the leading bits of each row's key hash. One
histogram of bytes by hash prefix is aggregated, and prefixes are summed for
every shorter depth; a bucket over the limit splits on its next bit, so a shard
is the shortest prefix that fits. Only prefixes that still do not fit at the
histogram's depth are counted again, deeper.

Rows never move to build the directory: the map-side aggregate leaves a few
dozen rows a shard. The directory joins back on the prefix, by broadcast only
under Spark's size threshold.

Defined cases: a null text has no bytes, a null id hashes as the empty string.
A row larger than the limit is a shard of its own. Rows with one key cannot be
told apart by bits: where they exceed the limit together, they are dealt into
pages of that bucket, each within the limit unless a single row exceeds it.
An empty table gives no shard. Repeated rows are placed alike. Only octets of the
text are counted, so its length does not matter. Other columns are returned as
they are; those with the names of the results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, saved

HASH_BITS = 48
RESULTS = ("n_bytes", "shard", "page", "local_depth", "shard_bytes")


def key_hash(key: str) -> Column:
    """The first 48 bits of the md5 of the key as text."""
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")


def _prefix(hash_col: Column, bits: Column | int) -> Column:
    bits = bits if isinstance(bits, Column) else F.lit(bits)
    return F.call_function("shiftright", hash_col, (F.lit(HASH_BITS) - bits).cast("int"))


def build_directory(rows: DataFrame, limit_bytes: int, fan_bits: int = 6) -> DataFrame:
    """Shards of rows (_h, _b): local_depth, prefix, shard_bytes, shard_rows, one_key, cell_bits and cell.

    A shard has one row per histogram cell below it, so that a row of the input finds its shard by its cell.
    """
    total = rows.agg(F.coalesce(F.sum("_b"), F.lit(0)).alias("b")).first()["b"]
    found, depth, step = None, 0, min(HASH_BITS, max(0, int(total // max(1, limit_bytes)).bit_length()) + fan_bits)
    open_rows = rows
    while True:
        bits = min(HASH_BITS, depth + step)
        cells = open_rows.groupBy(_prefix(F.col("_h"), bits).alias("cell")).agg(
            F.sum("_b").alias("b"), F.count("*").alias("n"), F.min("_h").alias("lo"), F.max("_h").alias("hi")
        )
        cells = saved(cells, "cells")
        levels = cells.withColumn("d", F.explode(F.sequence(F.lit(depth), F.lit(bits)))).withColumn(
            "p", F.call_function("shiftright", F.col("cell"), (F.lit(bits) - F.col("d")).cast("int"))
        )
        buckets = levels.groupBy("d", "p").agg(F.sum("b").alias("b"), F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        fitting = buckets.where((F.col("b") <= limit_bytes) | (F.col("lo") == F.col("hi")))
        # the shortest fitting prefix of a cell: prefixes only shrink with depth
        shortest = levels.join(fitting.select("d", "p", F.col("b").alias("fb"), F.col("n").alias("fn"), (F.col("lo") == F.col("hi")).alias("one")), ["d", "p"])
        shards = shortest.groupBy("cell").agg(F.min(F.struct("d", "p", "fb", "fn", "one")).alias("s"))
        shards = shards.select(
            F.lit(bits).alias("cell_bits"),
            "cell",
            F.col("s.d").alias("local_depth"),
            F.col("s.p").alias("prefix"),
            F.col("s.fb").alias("shard_bytes"),
            F.col("s.fn").alias("shard_rows"),
            F.col("s.one").alias("one_key"),
        )
        found = shards if found is None else found.unionByName(shards)
        left = saved(cells.join(shards, "cell", "left_anti").select("cell"), "oversized")
        if bits == HASH_BITS or left.isEmpty():
            return saved(found, "directory")
        open_rows = open_rows.join(left, _prefix(F.col("_h"), bits) == F.col("cell"), "left_semi")
        depth, step = bits + 1, fan_bits


def assign_shards(rows: DataFrame, limit_bytes: int, key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """rows with shard (the prefix's bits as text), page, local_depth, shard_bytes and n_bytes.

    ``keep`` names the input columns to return (all by default); one with the name of a result is replaced.
    """
    kept = [c for c in (rows.columns if keep is None else keep) if c.lower() not in RESULTS]
    measured = rows.select(
        F.struct(*map(column, kept)).alias("_row"), key_hash(key).alias("_h"), F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("_b")
    )
    directory = build_directory(measured.select("_h", "_b"), limit_bytes)
    depths = [r["cell_bits"] for r in directory.select("cell_bits").distinct().orderBy("cell_bits").collect()]
    placed = None
    left = measured
    for bits in depths:  # nearly always one; each deeper directory holds only what did not fit before
        part = directory.where(F.col("cell_bits") == bits).drop("cell_bits")
        at = _prefix(F.col("_h"), bits) == F.col("cell")
        inside = left.join(part, at)
        placed = inside if placed is None else placed.unionByName(inside)
        if bits != depths[-1]:
            left = left.join(part, at, "left_anti")
    if placed is None:
        placed = measured.join(directory.drop("cell_bits"), F.lit(False))
    over = (F.col("shard_bytes") > limit_bytes) & (F.col("shard_rows") > 1)
    if directory.where(over).isEmpty():
        placed = placed.withColumn("page", F.lit(0).cast("long"))
    else:
        placed = placed.where(~over).withColumn("page", F.lit(0).cast("long")).unionByName(_paged(saved(placed.where(over), "one-key-rows"), limit_bytes))
    bits_text = F.when(F.col("local_depth") == 0, F.lit("")).otherwise(
        F.lpad(F.conv(F.col("prefix").cast("string"), 10, 2), F.col("local_depth"), F.lit("0"))
    )
    return placed.select(
        "_row.*",
        F.col("_b").alias("n_bytes"),
        bits_text.alias("shard"),
        "page",
        F.col("local_depth").cast("long").alias("local_depth"),
        F.col("shard_bytes"),
    )


def _paged(rows: DataFrame, limit_bytes: int) -> DataFrame:
    """Deals the rows of one-key buckets into pages; each partition of the saved table numbers its own pages, anew in the same way if it is lost."""
    rows = rows.withColumn("_i", F.monotonically_increasing_id()).withColumn("_part", F.call_function("shiftright", F.col("_i"), F.lit(33)))
    large = F.col("_b") * 2 > limit_bytes
    before = Window.partitionBy("prefix", "local_depth", "_part", "_large").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    filled = F.coalesce(F.sum("_b").over(before), F.lit(0))
    page = F.when(F.col("_large"), F.col("_i") * 2 + 1).otherwise(
        (F.call_function("shiftleft", F.col("_part"), F.lit(33)) + F.floor(filled * 2 / F.lit(max(1, limit_bytes)))) * 2
    )
    return rows.withColumn("_large", large).withColumn("page", page.cast("long")).drop("_i", "_part", "_large")
