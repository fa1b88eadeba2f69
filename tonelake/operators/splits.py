"""Exact, stratified, reproducible splits as one extra column."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .sampling import bucket_counts, cut_points, order_hash
from .skew import lookup_join


def quotas(sizes: DataFrame, total: int, of: str = "n", out: str = "quota") -> DataFrame:
    """Add each class's share of ``total``, in proportion to ``of``, by largest remainder.

    Whole-number arithmetic; equal remainders go to the smaller class first. One
    window over the classes, a row each.
    """
    n = F.sum(of).over(Window.partitionBy())
    wide = f"cast(cast({of} as decimal(38,0)) * {total} as decimal(38,0))"
    parts = sizes.withColumn("all_rows", n.cast("decimal(38,0)")).withColumns(
        {
            "base": F.expr(f"coalesce({wide} div all_rows, 0)"),
            "rest": F.expr(f"coalesce({wide} % all_rows, 0)"),
        }
    )
    turn = F.row_number().over(Window.orderBy(F.desc("rest"), "class"))
    left = F.lit(total) - F.sum("base").over(Window.partitionBy())
    return parts.withColumns({"turn": turn, "left_over": left}).select(
        *sizes.columns,
        (F.col("base") + (F.col("turn") <= F.col("left_over")).cast("int")).cast("bigint").alias(out),
    )


def _check_sizes(n: int, test_size: float, val_size: float | None) -> None:
    for name, size in (("test_size", test_size), ("val_size", val_size)):
        if size is not None and not 0 < size < 1:
            raise ValueError(f"{name} is a share over 0 and under 1, not {size}")
    if val_size is not None and test_size + val_size >= 1:
        raise ValueError(
            f"shares of {test_size} and {val_size} leave nothing to train on"
        )
    needed = 10 if val_size is None else 20
    if n < needed:
        raise ValueError(f"too few rows: at least {needed} needed, {n} given")
    if val_size is None and n * test_size < 2:
        raise ValueError(
            f"too few rows: at least {int(2 / test_size)} needed, {n} given"
        )


def _check_classes(classes: int, nulls: int, least: int, parts: list[int]) -> None:
    if nulls:
        raise ValueError("the stratify column holds nulls")
    if least < 2:
        raise ValueError("every class needs at least 2 rows")
    if min(parts) < classes:
        raise ValueError(f"each split needs at least {classes} rows, one per class")


def with_split(
    df: DataFrame,
    test_size: float = 0.2,
    val_size: float | None = None,
    stratify: str | None = "label",
    seed: int = 42,
    key: str = "review_id",
) -> DataFrame:
    """Add ``split``: test, train and, with ``val_size``, val.

    Validation is a fraction of what the test set leaves. Test and validation
    are neighbouring stretches of one hash order, so both come from the same
    two narrow passes over key and class; the rows themselves are not shuffled.
    """
    grouped = bool(stratify) and stratify in df.columns
    label: Column = F.col(stratify) if grouped else F.lit(0)
    h = order_hash(key, f"{seed}|split")
    hashed = df.select(label.alias("class"), h.alias("h"))
    counts = materialize(bucket_counts(hashed), "split-counts")
    sizes = materialize(counts.groupBy("class").agg(F.sum("n").alias("n")), "class-sizes")
    n, classes, nulls, least = sizes.agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.count_if(F.isnull("class")), F.min("n")
    ).first()
    _check_sizes(n, test_size, val_size)
    n_test = math.ceil(n * test_size)
    n_val = math.ceil((n - n_test) * val_size) if val_size else 0
    parts = [n_test, n - n_test - n_val] + ([n_val] if val_size else [])
    if grouped:
        _check_classes(classes, nulls, least, parts)
    shares = quotas(sizes, n_test, "n", "test").withColumn("left", F.col("n") - F.col("test"))
    shares = quotas(shares, n_val, "left", "val")
    cuts = F.array(
        F.struct(F.lit("test").alias("cut"), F.col("test").alias("rank")),
        F.struct(F.lit("val").alias("cut"), (F.col("test") + F.col("val")).alias("rank")),
    )
    targets = materialize(shares.select("class", F.inline(cuts)), "split-targets")
    # a row per class, stored: later passes over the split only look it up
    found = materialize(
        cut_points(hashed, counts, targets)
        .groupBy(F.col("class").alias("split_class"))
        .agg(
            F.max(F.when(F.col("cut") == "test", F.col("h"))).alias("test_cut"),
            F.max(F.when(F.col("cut") == "val", F.col("h"))).alias("val_cut"),
        ),
        "split-cuts",
    )
    placed = lookup_join(df.withColumn("split_class", label), found, "split_class", [key])
    return placed.select(
        *df.columns,
        F.when(h <= F.col("test_cut"), "test")
        .when(h <= F.col("val_cut"), "val")
        .otherwise("train")
        .alias("split"),
    )


def part(df: DataFrame, name: str) -> DataFrame:
    """The rows of one split."""
    return df.filter(F.col("split") == name).drop("split")


def split_train_test(
    df: DataFrame,
    test_size: float = 0.2,
    stratify: str | None = "label",
    seed: int = 42,
    key: str = "review_id",
) -> tuple[DataFrame, DataFrame]:
    out = with_split(df, test_size, None, stratify, seed, key)
    return part(out, "train"), part(out, "test")


def split_train_val_test(
    df: DataFrame,
    test_size: float = 0.2,
    val_size: float = 0.1,
    stratify: str | None = "label",
    seed: int = 42,
    key: str = "review_id",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    out = with_split(df, test_size, val_size, stratify, seed, key)
    return part(out, "train"), part(out, "val"), part(out, "test")


def check_split(
    df: DataFrame, label_col: str = "label", key: str = "review_id"
) -> DataFrame:
    """``(split, label, rows, split_rows, class_share, shared_keys)``.

    ``shared_keys`` counts keys found in more than one split, over the table.
    """
    cells = df.groupBy("split", F.col(label_col).alias("label")).agg(
        F.count(F.lit(1)).alias("rows")
    )
    totals = cells.groupBy("split").agg(F.sum("rows").alias("split_rows"))
    shared = (
        df.groupBy(key)
        .agg((F.min("split") != F.max("split")).alias("torn"))
        .agg(F.count_if("torn"))
        .scalar()
    )
    return cells.join(totals, "split").select(
        "split", "label", "rows", "split_rows",
        (F.col("rows") / F.col("split_rows")).alias("class_share"),
        shared.alias("shared_keys"),
    )
