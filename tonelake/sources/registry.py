"""The list of trained models: ``name, path, type, registered_at``.

A registry is a JSON list and a log beside it, ``<path>.log``. Writers add entries to the log, each in
a folder of its own, so any number of them may write at once. Readers take the latest entry
of each name. ``compact_registry`` puts the log into the list now and then.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ENTRY = "name string, path string, type string, registered_at string"
SCHEMA = f"position bigint, {ENTRY}"
LOGGED = f"{ENTRY}, stamp string"


def parse_registry(text: Column) -> Column:
    """JSON list of entries to an array; null for anything but a list."""
    return F.when(
        text.rlike(r"^\s*\["), F.from_json(text, f"array<struct<{_fields()}>>")
    )


def _fields() -> str:
    return ", ".join(f.strip().replace(" ", ":") for f in ENTRY.split(","))


def resolve_path(path: Column, root: str | None) -> Column:
    """Relative paths under ``root``; absolute ones and URIs as they are."""
    if root is None:
        return path
    absolute = path.startswith("/") | path.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:")
    return F.when(absolute, path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))


def read_registry(
    spark: SparkSession,
    path: str,
    root: str | None = None,
    known: Iterable[tuple[str, str, str]] = (),
) -> DataFrame:
    """Entries in list order with ``position``, those of the log merged in.

    A corrupt list is empty. Where there is no registry, it is made of those
    ``known`` ``(name, path, type)`` models whose folder exists.
    """
    logged = _log_parts(spark, path)
    df = _read_list(spark, path, () if logged else known)
    if logged:
        df = _merged(df, spark.read.schema(LOGGED).json(logged))
    return df.withColumn("path", resolve_path(F.col("path"), root))


def _read_list(spark: SparkSession, path: str, known: Iterable[tuple[str, str, str]]) -> DataFrame:
    try:
        # a registry is one small file; its list order is the order of entries
        files = spark.read.text(path, wholetext=True)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        found = [(n, p, t) for n, p, t in known if _exists(spark, p)]
        entries = [(i, *entry, None) for i, entry in enumerate(found)]
        df = spark.createDataFrame(entries, SCHEMA)
    else:
        df = files.select(F.posexplode(parse_registry(F.col("value")))).select(
            F.col("pos").cast("bigint").alias("position"), "col.*"
        )
    return df


def _merged(listed: DataFrame, logged: DataFrame) -> DataFrame:
    """Names in the order they came in, each with its latest entry."""
    entry = F.struct("path", "type", "registered_at")
    none = F.lit(None).cast("bigint")
    old = listed.select("name", "position", F.lit("").alias("stamp"), entry.alias("entry"))
    # of equal names in a list the last one counts
    new = logged.filter(F.col("name").isNotNull()).select("name", none.alias("position"), "stamp", entry.alias("entry"))
    latest = F.max(F.struct("stamp", "position", "entry"))
    rows = old.unionByName(new).groupBy("name").agg(
        F.min("position").alias("position"), F.min("stamp").alias("first"), latest.alias("latest")
    )
    # a registry has a row for each model, few enough to number in one task
    order = Window.orderBy(F.col("position").asc_nulls_last(), "first", "name")
    return rows.select(
        (F.row_number().over(order) - 1).cast("bigint").alias("position"), "name", "latest.entry.*"
    )


def _store(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _log_parts(spark: SparkSession, path: str) -> list[str]:
    """Folders of the log that their writers have finished."""
    store, folder = _store(spark, f"{path.rstrip('/')}.log")
    if not store.exists(folder):
        return []
    parts = sorted(str(s.getPath()) for s in store.listStatus(folder) if s.isDirectory())
    return [p for p in parts if store.exists(_store(spark, f"{p}/_SUCCESS")[1])]


def log_models(entries: DataFrame, path: str) -> None:
    """Add entries ``name, path, type`` to the log of the registry at ``path``.

    Written by Spark where they are, in a folder that no other writer uses. Entries of one call
    have one time; of a name that comes twice in it the greatest path counts.
    """
    now = dt.datetime.now(dt.timezone.utc)
    stamp = f"{now:%Y%m%dT%H%M%S.%f}-{uuid.uuid4().hex}"
    rows = entries.select(
        F.col("name").cast("string").alias("name"),
        F.col("path").cast("string").alias("path"),
        F.col("type").cast("string").alias("type"),
        F.lit(dt.datetime.now().isoformat()).alias("registered_at"),
        F.lit(stamp).alias("stamp"),
    )
    rows.write.json(f"{path.rstrip('/')}.log/{stamp}")


def compact_registry(spark: SparkSession, path: str) -> DataFrame:
    """Put the log as it is now into the list, and return this.

    A job of its own, one at a time; writers and readers needn't stop. The new list is written beside the old
    one and put in its place, then the parts of the log that are in it go. A run that ends between
    leaves entries both in the list and the log, which reads the same.
    """
    parts = _log_parts(spark, path)
    df = _read_list(spark, path, ())
    if parts:
        df = _merged(df, spark.read.schema(LOGGED).json(parts))
    beside = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    write_registry(df, beside)
    _swap(spark, beside, path)
    for part in parts:
        store, folder = _store(spark, part)
        store.delete(folder, True)
    return read_registry(spark, path)


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        return spark.read.format("binaryFile").option(
            "recursiveFileLookup", True
        ).load(path).select("path").limit(1).count() > 0
    except AnalysisException:
        return False


def new_entry(
    spark: SparkSession, name: str, path: str, model_type: str
) -> DataFrame:
    now = dt.datetime.now().isoformat()
    return spark.createDataFrame([(name, str(path), model_type, now)], ENTRY)


def upsert_models(registry: DataFrame, entries: DataFrame) -> DataFrame:
    """Replace entries of the same name in place, append the others by name.

    ``entries`` is unique by name. New positions follow the highest old one.
    """
    merged = registry.withColumn("old", F.lit(True)).unionByName(
        entries.select(
            F.lit(None).cast("bigint").alias("position"), "name", "path", "type",
            "registered_at", F.lit(False).alias("old"),
        )
    )
    # one row per name: the new values if there are any, the old position
    latest = F.min(F.struct("old", "path", "type", "registered_at"))
    rows = merged.groupBy("name").agg(
        F.min("position").alias("position"), latest.alias("entry")
    )
    order = Window.orderBy(F.col("position").asc_nulls_last(), "name")
    return rows.select(
        (F.row_number().over(order) - 1).cast("bigint").alias("position"),
        "name", "entry.path", "entry.type", "entry.registered_at",
    )


def write_registry(registry: DataFrame, path: str) -> None:
    """Store as one JSON list, in order. A registry is a short list of models."""
    entry = F.struct("name", "path", "type", "registered_at")
    rows = F.sort_array(F.collect_list(F.struct("position", entry.alias("entry"))))
    listed = F.to_json(F.transform(rows, lambda r: r["entry"])).alias("value")
    registry.agg(listed).coalesce(1).write.mode("overwrite").text(path)


def _swap(spark: SparkSession, new: str, path: str) -> None:
    """Put a folder in another's place; the old one is there until the new one is."""
    jvm = spark.sparkContext._jvm
    source, target = jvm.org.apache.hadoop.fs.Path(new), jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    spare = jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + ".previous")
    if store.exists(target):
        store.delete(spare, True)
        store.rename(target, spare)
    if not store.rename(source, target):
        store.rename(spare, target)
        raise OSError(f"cannot put the registry at {path}")
    store.delete(spare, True)


def register_model(
    spark: SparkSession, path: str, name: str, model_path: str, model_type: str
) -> DataFrame:
    """Add or update one model in the stored registry and return it."""
    entry = spark.createDataFrame([(name, str(model_path), model_type)], "name string, path string, type string")
    log_models(entry, path)
    return read_registry(spark, path)
