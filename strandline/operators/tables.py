"""Intermediate tables in the folder that driver and executors share, and cells that cut an order into ranges."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where none is set: a temporary one in local mode, an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="strandline-"))
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def saved(df: DataFrame, label: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: its sources are read once, its lineage ends."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_cells(values: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """values with _cell, the number of the range of (group, order) that holds a row: a saved table.

    Spark's range partitions are the cells, so their number and size follow the data and no task orders a whole
    group. What ``values`` is made of is read once. Null groups and values are values like others.
    """
    return saved(values.repartitionByRange(*[F.col(g) for g in group], *order).withColumn("_cell", F.spark_partition_id()), "cells")


def same(a: DataFrame, b: DataFrame, keys: dict[str, str]) -> Column:
    """Null-safe equality of a's columns with b's."""
    on = F.lit(True)
    for x, y in keys.items():
        on = on & a[x].eqNullSafe(b[y])
    return on
