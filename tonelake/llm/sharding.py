"""Contiguous shards of nearly equal bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

SHARDS = 8


def shard_by_bytes(
    docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Shard and slot of every document, by the running total of bytes in id order.

    A document's size is its UTF-8 bytes plus 1 (null text: 1). Documents are
    ordered by id (nulls first), then crc32 and size. Its shard is the one in
    whose equal share of all bytes the document's middle falls, so shards are
    contiguous runs of ids and differ by less than one document's size on either
    side of a cut. ``slot`` counts a shard's documents from 0. Rows alike in all
    of these are interchangeable; each gets a slot of its own. More shards than
    documents leave some empty; an empty table gives no rows.

    Texts are read once, for size and checksum. The narrow rows are sorted by
    range, each range adds up its bytes and rows, and the ranges' totals (one row
    for each range) give every range its offset.
    """
    text = F.col(text_col).cast("string")
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")
    narrow = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        size.alias("size"),
        F.crc32(F.coalesce(text.cast("binary"), F.lit(b""))).alias("text_crc32"),
    )
    order = ["doc_id", "text_crc32", "size"]
    # rows alike in all of these, however many, can be parted
    narrow = narrow.withColumn("row", F.monotonically_increasing_id())
    ranges = materialize(
        narrow.repartitionByRange(*order, "row").withColumn("range", F.spark_partition_id()),
        "shard-ranges",
    )
    totals = ranges.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    offsets = totals.select(
        "range",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(every).alias("all_bytes"),
    )
    inside = Window.partitionBy("range").orderBy(*order, "row").rowsBetween(Window.unboundedPreceding, 0)
    # one row a range, so small whatever the input
    placed = (
        ranges.withColumns({"upto": F.sum("size").over(inside), "nth": F.count(F.lit(1)).over(inside)})
        .join(F.broadcast(offsets), "range")
        .select(
            *order,
            F.expr(
                f"least({shards - 1}, ((bytes_before + upto) * 2 - size) * {shards} div (all_bytes * 2))"
            ).cast("int").alias("shard"),
            (F.col("rows_before") + F.col("nth")).alias("nth"),
        )
    )
    placed = materialize(placed, "shard-places")
    firsts = placed.groupBy("shard").agg(F.min("nth").alias("first"))
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("nth") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
