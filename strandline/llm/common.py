"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z only; other letters stay."""
    return F.translate(col, ASCII_UPPER, ASCII_UPPER.lower())


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where none is set: a temporary one in local mode, an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="strandline-"))
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


#: Paths of saved tables by the DataFrame that reads them.
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def saved(df: DataFrame, label: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def dropped(df: DataFrame) -> None:
    """Removes a saved table whose last reader is done; other DataFrames stay as they are."""
    path = _paths.pop(df, None)
    if path is not None:
        where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df has not, whatever its case."""
    used = {c.lower() for c in df.columns}
    while name.lower() in used:
        name = "_" + name
    return name


def column(name: str) -> Column:
    """The column of exactly this name, which may hold dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str, folds: int) -> Column:
    """True where crc32 of the id as text leaves no remainder (null ids: false)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 0, F.lit(False))


def annotate(
    df: DataFrame,
    make: Callable[[], Callable[[pa.RecordBatch], pa.StructArray]],
    result: T.StructType,
    name: str = "_sl",
    keep: list[str] | None = None,
    parts: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]] | None = None,
) -> DataFrame:
    """Adds a struct column that ``make()`` computes from record batches of df, or from the ``parts`` of each.

    ``make`` runs once a task and returns the function for its batches. ``keep``
    names the input columns to return (all by default); one called ``name`` is replaced. No row moves.
    """
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() != name.lower()]
    # Python functions over a table take no names with dots, so these are plain while it runs
    plain = {c: free_name(df, f"_column{i}") if "." in c or "`" in c else c for i, c in enumerate(df.columns)}
    schema = T.StructType([T.StructField(plain[c], df.schema[c].dataType) for c in kept] + [T.StructField(name, result)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for whole in batches:
            for batch in [whole] if parts is None else parts(whole):
                yield pa.RecordBatch.from_arrays([*(batch.column(plain[c]) for c in kept), compute(batch)], schema.names)

    return df.toDF(*plain.values()).mapInArrow(run, schema).toDF(*kept, name)


def at_most(df: DataFrame, count: str, limit: int) -> int | None:
    """A value of ``count`` that at most ``limit`` rows of df reach, near the smallest such; None if even the largest has more.

    Large values are taken together in steps of a hundredth, so the driver sees a few thousand rows at any size.
    """
    step = F.when(F.col(count) < 1000, F.col(count)).otherwise(F.floor(F.log(F.col(count)) * 100) + 1000)
    levels = df.groupBy(step.alias("level")).agg(F.count("*").alias("n"), F.min(count).alias("least")).orderBy(F.desc("level")).toPandas()
    fits = levels[levels["n"].cumsum() <= limit]
    return None if fits.empty else int(fits["least"].min())
