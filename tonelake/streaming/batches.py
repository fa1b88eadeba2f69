"""Scoring requests whose rows arrive one by one, each request accepted or refused as a whole."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import lexicons as lx
from ..operators.scoring import predict_with_labels
from ..operators.skew import lookup_join
from ..operators.training import SentimentModel
from ..operators.validation import text_reason
from ..session import materialize

LATE, NO_BATCH, NO_TIME = "late", "missing_batch", "missing_time"
_UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def _seconds(span: str) -> int:
    match = re.fullmatch(r"\s*(\d+)\s*(second|minute|hour|day)s?\s*", span)
    if not match:
        raise ValueError(f"a time span is a number and a unit up to days, got {span!r}")
    return int(match[1]) * _UNITS[match[2]]


def _later(column, seconds: int):
    return F.timestamp_micros(F.unix_micros(column) + seconds * 1_000_000)


def batch_sessions(
    rows: DataFrame,
    time_col: str,
    batch_col: str,
    text_col: str,
    gap: str,
    max_items: int = lx.MAX_BATCH_ITEMS,
    max_chars: int = lx.MAX_TEXT_CHARS,
) -> DataFrame:
    """``batch_col, began, ends, verdict`` of each run of rows of a batch without a ``gap``.

    The verdict is null for a good one. Counted before the shuffle where sessions are plain, merged
    by session windows after it; texts don't travel.
    """
    return (
        rows.select(batch_col, time_col, text_reason(text_col, max_chars).isNotNull().alias("bad"))
        .groupBy(batch_col, F.session_window(time_col, gap).alias("session"))
        .agg(F.count(F.lit(1)).alias("items"), F.count_if("bad").alias("bad_items"))
        .select(
            batch_col,
            F.col("session.start").alias("began"),
            F.col("session.end").alias("ends"),
            F.when(F.col("items") > max_items, "too_many_items")
            .when(F.col("bad_items") > 0, "bad_item")
            .alias("verdict"),
        )
    )


def _slot(output_path: str, batch_id: int) -> str:
    return f"{output_path}/open/slot={batch_id % 2}"


def open_rows(spark: SparkSession, output_path: str) -> DataFrame:
    """Rows of requests that may still go on, as the last micro-batch left them."""
    slots = [spark.read.parquet(f"{_slot(output_path, n)}/mark") for n in (0, 1) if _exists(spark, output_path, n)]
    if not slots:
        raise FileNotFoundError(f"no stream has written to {output_path}")
    last = max(int(s.first()["batch"]) for s in slots)
    return spark.read.parquet(f"{_slot(output_path, last)}/rows")


def _exists(spark: SparkSession, output_path: str, n: int) -> bool:
    try:
        spark.read.parquet(f"{_slot(output_path, n)}/mark")
    except Exception as error:
        if getattr(error, "getCondition", str)() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def score_batch_stream(
    requests: DataFrame,
    model: SentimentModel,
    output_path: str,
    checkpoint: str,
    time_col: str,
    batch_col: str = "batch_id",
    text_col: str = "text",
    gap: str = "10 minutes",
    delay: str = "5 minutes",
    max_items: int = lx.MAX_BATCH_ITEMS,
    max_chars: int = lx.MAX_TEXT_CHARS,
    once: bool = True,
    interval: str = "10 seconds",
) -> StreamingQuery:
    """Judge each request when it is complete, and score the rows of good ones.

    Rows of one ``batch_col`` less than ``gap`` apart in event time are a request, also if
    they come in several micro-batches. It is complete when the watermark, ``delay`` behind the latest
    event time of the micro-batches up to now, passes its last row by ``gap``; then all of its
    rows go to ``scored`` or, with the same reason, to ``rejects``. Rows older than the
    watermark of the micro-batches before are late, so a request can't change once it is judged; they go to
    the rejects, as do rows without a time or a batch.

    Rows of open requests are kept as a table in ``output_path``, of which each micro-batch reads the
    version before its own and writes its own. As outputs do, this depends on the
    micro-batch alone, so one that is run again after a failure gives what it gave before. What is kept
    is bounded by what arrives within ``gap`` and ``delay``. ``open_rows`` shows it.
    """
    wait, behind = _seconds(gap), _seconds(delay)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = materialize(batch, "requests")
        mark, held = None, batch.limit(0)
        if batch_id:
            before = _slot(output_path, batch_id - 1)
            mark = spark.read.parquet(f"{before}/mark").first()["watermark"]
            held = spark.read.schema(batch.schema).parquet(f"{before}/rows")
        late = F.col(time_col) < F.lit(mark) if mark is not None else F.lit(False)
        reason = (
            F.when(F.col(time_col).isNull(), NO_TIME)
            .when(F.col(batch_col).isNull(), NO_BATCH)
            .when(late, LATE)
        )
        latest = batch.agg(F.max(time_col).alias("latest"))
        now = latest.select(
            F.lit(batch_id).cast("long").alias("batch"),
            F.greatest(F.lit(mark).cast("timestamp"), _later(F.col("latest").cast("timestamp"), -behind)).alias("watermark"),
        ).first()
        checked = batch.withColumn("reason", reason)
        rows = held.unionByName(checked.filter("reason IS NULL").drop("reason"))
        rows = rows.withColumn("__row", F.monotonically_increasing_id())
        sessions = batch_sessions(rows, time_col, batch_col, text_col, f"{wait} seconds", max_items, max_chars)
        sessions = materialize(sessions, "request-sessions")
        # a row is in one session of its batch
        marked = lookup_join(rows, sessions, batch_col, ["__row"], "inner").filter(
            (F.col(time_col) >= F.col("began")) & (F.col(time_col) < F.col("ends"))
        )
        names = batch.columns
        closed = F.col("ends") <= F.lit(now["watermark"]) if now["watermark"] else F.lit(False)
        marked = materialize(marked.select(*names, "verdict", closed.alias("closed")), "judged-rows")
        good = marked.filter("closed AND verdict IS NULL").select(*names)
        refused = marked.filter("closed AND verdict IS NOT NULL").select(
            *names, F.col("verdict").alias("reason")
        )
        refused = refused.unionByName(checked.filter("reason IS NOT NULL"))
        for df, path in (
            (predict_with_labels(model, good, text_col), f"{output_path}/scored/batch={batch_id}"),
            (refused, f"{output_path}/rejects/batch={batch_id}"),
            (marked.filter("NOT closed").select(*names), f"{_slot(output_path, batch_id)}/rows"),
            (spark.createDataFrame([now], "batch long, watermark timestamp"), f"{_slot(output_path, batch_id)}/mark"),
        ):
            df.write.mode("overwrite").parquet(path)

    writer = requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if once:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=interval).start()
