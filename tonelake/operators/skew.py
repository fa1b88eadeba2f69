"""Joins that hold up when one key has a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A key with more rows than this is hot. There can be at most
# total_rows / HOT_ROWS of them, which keeps their broadcast small.
HOT_ROWS = 1_000_000
# Lookup tables up to this many rows are broadcast, larger ones shuffled.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 * 1024 * 1024
SALTS = 64


def fits_broadcast(df: DataFrame, max_rows: int | None = None) -> bool:
    """Whether a table is small in rows and in bytes of its strings.

    Reads no more than ``max_rows`` rows; pass a stored table.
    """
    max_rows = BROADCAST_ROWS if max_rows is None else max_rows
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in texts), F.lit(0))
    rows, used = (
        df.limit(max_rows + 1)
        .agg(F.count(F.lit(1)), F.coalesce(F.sum(size.cast("bigint")), F.lit(0)))
        .first()
    )
    return rows <= max_rows and used <= BROADCAST_BYTES


def narrow_join(
    rows: DataFrame, narrow: DataFrame, key: str, how: str = "inner", max_rows: int | None = None
) -> DataFrame:
    """Join wide rows to a narrow table by a key that no large share of rows has.

    A narrow table of checked size is broadcast, and the rows stay where they are. A larger one is
    hashed part by part, so that the rows are shuffled once and never sorted or spilled.
    """
    if fits_broadcast(narrow, max_rows):
        return rows.join(F.broadcast(narrow), key, how)
    return rows.join(narrow.hint("shuffle_hash"), key, how)


def attach_group_facts(
    rows: DataFrame,
    facts: DataFrame,
    key: str,
    size_col: str,
    spread_by: Column,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Left-join one fact row per ``key`` to rows, hot keys included.

    Facts of hot keys are broadcast, if they are as few as they should be. The rows of
    such keys then take a salt no cold fact carries, so the shuffle join spreads them
    evenly; ``spread_by`` should differ from row to row. Pass stored facts.
    """
    if not fits_broadcast(facts.filter(F.col(size_col) > hot_rows)):
        return lookup_join(rows.withColumn("__row", spread_by), facts, key, ["__row"]).select(
            *rows.columns, *[c for c in facts.columns if c != key]
        )
    names = [c for c in facts.columns if c != key]
    hot = facts.filter(F.col(size_col) > hot_rows).select(
        key, *[F.col(c).alias(f"hot_{c}") for c in names]
    )
    cold = facts.filter(F.col(size_col) <= hot_rows).select(
        key, F.lit(0).alias("salt"), *[F.col(c).alias(f"cold_{c}") for c in names]
    )
    apart = F.col(f"hot_{size_col}").isNotNull() | F.col(key).isNull()
    salted = rows.join(F.broadcast(hot), key, "left").withColumn(
        "salt",
        F.when(apart, 1 + F.pmod(F.xxhash64(spread_by), F.lit(4096)).cast("int"))
        .otherwise(0),
    )
    return salted.join(cold, [key, "salt"], "left").select(
        *rows.columns,
        *[F.coalesce(f"hot_{c}", f"cold_{c}").alias(c) for c in names],
    )


def lookup_join(
    rows: DataFrame,
    lookup: DataFrame,
    key: str | Sequence[str],
    spread_by: Sequence[str],
    how: str = "left",
    max_rows: int | None = None,
) -> DataFrame:
    """Join rows to a lookup table that is unique by ``key``.

    A lookup of checked size is broadcast. A larger one is repeated once per
    salt, so that a frequent key is shared out over ``SALTS`` tasks.
    """
    keys = [key] if isinstance(key, str) else list(key)
    if fits_broadcast(lookup, max_rows):
        return rows.join(F.broadcast(lookup), keys, how)
    salt = F.pmod(F.xxhash64(*spread_by), F.lit(SALTS)).cast("int")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    return (
        rows.withColumn("salt", salt)
        .join(lookup.withColumn("salt", salts), [*keys, "salt"], how)
        .drop("salt")
    )
