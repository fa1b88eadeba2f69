"""The shared folder jobs write intermediate tables to."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Spark's default size of an input split
SPLIT_BYTES = 128 * 1024 * 1024
# Bytes of stored texts that one task works on, where they are dealt out
PIECE_BYTES = 16 * 1024 * 1024


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as the session names it.

    Only a local session that names none gets a temporary folder.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="tonelake-"))
    return context.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back.

    Cuts the lineage: a lost executor costs a re-read, not a re-run. Columnar, so
    later passes over a few columns read only those.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, path: str, splittable: bool = True) -> DataFrame:
    """Share out the rows of an input that has fewer pieces than there are cores, or larger ones than ``PIECE_BYTES``.

    Cleaning costs far more than moving a text once, and a file of one row
    group, or a CSV file with multi-line records, is read by one task. An input
    of enough files, or of enough splits, is left where it is. Rows are dealt in turn, so
    no key, however frequent, decides where they go; pieces stay small as the input grows.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    # file sizes only, the contents are not read
    files, size = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(path)
        .agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0)))
        .first()
    )
    pieces = max(cores, math.ceil(size / PIECE_BYTES))
    if files >= pieces or (splittable and size > cores * SPLIT_BYTES):
        return df
    return df.repartition(pieces)
