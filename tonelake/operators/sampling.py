"""Seeded order of rows, exact cut points in it, and sampling.

Rows are ordered by a hash of their key, a seed and a purpose, so a sample and a
split with the same seed are independent. "The first k rows" is then a plain
comparison with the hash of the k-th row. That hash is found by counting rows by the
first digits of the hash, and by more digits inside the bucket that holds the k-th, until
a bucket is small enough to sort in a task.
With unique keys sizes are exact; copies of a key always stay together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .skew import lookup_join

BUCKET_DIGITS = 3
# Rows of a bucket that one task sorts
BUCKET_ROWS = 500_000
HASH_DIGITS = 32


def order_hash(key: str | Column, seed: int | str) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed))).cast("binary"))


def bucket_counts(hashed: DataFrame) -> DataFrame:
    """Rows per class and hash bucket of a ``(class, h)`` table."""
    return hashed.groupBy(
        "class", F.substring("h", 1, BUCKET_DIGITS).alias("bucket")
    ).agg(F.count(F.lit(1)).alias("n"))


def _holding(counts: DataFrame, targets: DataFrame) -> DataFrame:
    """The bucket that holds each target rank, and the rank within it.

    ``counts`` has ``(class, bucket, n)``, ``targets`` ``(class, cut, rank)`` and, from
    the second round on, the ``prefix`` that a bucket must begin with.
    """
    keys = [c for c in ("class", "prefix") if c in counts.columns]
    running = counts.withColumn(
        "upto", F.sum("n").over(Window.partitionBy(*keys).orderBy("bucket"))
    )
    return (
        lookup_join(running, targets, keys, ["bucket"], "inner")
        .filter((F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("n")))
        .select(
            "class", "cut", F.col("bucket").alias("prefix"),
            (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"), "n",
        )
    )


def _inside(hashed: DataFrame, held: DataFrame, digits: int) -> DataFrame:
    """Rows of the held buckets, once for each bucket."""
    buckets = held.select("class", "prefix").distinct()
    rows = hashed.withColumn("prefix", F.substring("h", 1, digits))
    return lookup_join(rows, buckets, ["class", "prefix"], ["h"], "inner")


def cut_points(
    hashed: DataFrame, counts: DataFrame, targets: DataFrame, bucket_rows: int | None = None
) -> DataFrame:
    """``(class, cut, h)``: the hash at each target rank of each class.

    ``targets`` holds ``(class, cut, rank)``, a few rows per class, stored; rank 0 has
    no cut point and gives no row.
    """
    most = BUCKET_ROWS if bucket_rows is None else bucket_rows
    digits = BUCKET_DIGITS
    held = materialize(_holding(counts, targets), "cut-buckets")
    while digits < HASH_DIGITS and (held.agg(F.max("n")).first()[0] or 0) > most:
        digits += BUCKET_DIGITS
        finer = (
            _inside(hashed, held, digits - BUCKET_DIGITS)
            .groupBy("class", "prefix", F.substring("h", 1, digits).alias("bucket"))
            .agg(F.count(F.lit(1)).alias("n"))
        )
        held = materialize(_holding(finer, held.drop("n")), "cut-buckets")
    # copies of a key share a hash and are one row from here on
    merged = (
        _inside(hashed, held, digits)
        .groupBy("class", "prefix", "h")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    upto = F.sum("n").over(Window.partitionBy("class", "prefix").orderBy("h"))
    ranked = merged.withColumn("upto", upto)
    return (
        lookup_join(ranked, held.drop("n"), ["class", "prefix"], ["h"], "inner")
        .filter((F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("n")))
        .select("class", "cut", "h")
    )


def sample_hash(key: str | Column, seed: int | str) -> Column:
    """The order that samples are drawn in."""
    return order_hash(key, f"{seed}|sample")


def drawn(key: str | Column, frac: float, seed: int | str) -> Column:
    """Whether a row is in a sample that is right in size on average."""
    return F.substring(sample_hash(key, seed), 1, 8) < format(int(frac * 2**32), "08x")


def check_fraction(frac: float) -> None:
    if not 0 < frac <= 1:
        raise ValueError(f"sample fraction must be between 0 and 1, got {frac}")


def sample_fraction(
    df: DataFrame, frac: float, seed: int, key: str, exact: bool = True
) -> DataFrame:
    """Reproducible sample without replacement.

    Exact: ``round(frac * n)`` rows, found by two passes over the key. Otherwise
    each row stands on its own: no pass, a size that is right on average.
    """
    check_fraction(frac)
    if frac == 1:
        return df
    if not exact:
        return df.filter(drawn(key, frac, seed))
    h = sample_hash(key, seed)
    hashed = df.select(F.lit(0).alias("class"), h.alias("h"))
    counts = materialize(bucket_counts(hashed), "sample-counts")
    target = materialize(
        counts.groupBy("class").agg(
            F.lit("sample").alias("cut"),
            F.bround(F.sum("n") * F.lit(float(frac)), 0).cast("bigint").alias("rank"),
        ),
        "sample-size",
    )
    # one hash, found once: later passes over the sample only compare with it
    last = cut_points(hashed, counts, target).agg(F.max("h")).first()[0]
    return df.filter(h <= last) if last else df.limit(0)
