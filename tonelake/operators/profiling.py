"""Table profiles: nulls, types, summaries and label counts.

Exact percentiles and exact distinct counts, without sorting or shuffling
whole columns in one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
           T.DoubleType, T.DecimalType)
DATES = (T.DateType, T.TimestampType, T.TimestampNTZType)
QUARTILES = (0.25, 0.5, 0.75)
# percentile_approx is off by at most n / SKETCH_SIZE ranks
SKETCH_SIZE = 10_000
# a bracket with more rows than this is narrowed before its values are ranked
MAX_INSIDE = 5_000_000


def kind_of(data_type: T.DataType) -> str:
    if isinstance(data_type, NUMERIC):
        return "numeric"
    return "date" if isinstance(data_type, DATES) else "categorical"


def columns_of(df: DataFrame, kind: str) -> list[str]:
    return [f.name for f in df.schema.fields if kind_of(f.dataType) == kind]


def _tall(df: DataFrame, rows: Sequence[Sequence[Column]]) -> DataFrame:
    """One-row ``df`` to one row per entry of ``rows``."""
    return df.select(F.inline(F.array(*[F.struct(*r) for r in rows])))


def null_counts(df: DataFrame) -> DataFrame:
    """``(column_name, nulls)`` from one aggregate."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return _tall(
        counts,
        [
            (F.lit(c).alias("column_name"), F.col(c).alias("nulls"))
            for c in df.columns
        ],
    )


def column_info(df: DataFrame) -> DataFrame:
    """``(position, column_name, data_type, kind, non_null)``."""
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns])
    return _tall(
        counts,
        [
            (
                F.lit(i).alias("position"),
                F.lit(f.name).alias("column_name"),
                F.lit(f.dataType.simpleString()).alias("data_type"),
                F.lit(kind_of(f.dataType)).alias("kind"),
                F.col(f.name).alias("non_null"),
            )
            for i, f in enumerate(df.schema.fields)
        ],
    )


def _number(name: str) -> Column:
    """A numeric column as double, NaN counted as missing."""
    value = F.col(name).cast("double")
    return F.when(~F.isnan(value), value)


def numeric_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Moments of each column, from one aggregate over the table."""
    aggs = []
    for i, c in enumerate(columns):
        v = _number(c)
        aggs += [
            F.count(v).alias(f"n{i}"), F.avg(v).alias(f"mean{i}"),
            F.stddev_samp(v).alias(f"std{i}"), F.min(v).alias(f"min{i}"),
            F.max(v).alias(f"max{i}"),
        ]
    return _tall(
        df.agg(*aggs),
        [
            (
                F.lit(c).alias("column_name"), F.col(f"n{i}").alias("count"),
                F.col(f"mean{i}").alias("mean"), F.col(f"std{i}").alias("std"),
                F.col(f"min{i}").alias("min"), F.col(f"max{i}").alias("max"),
            )
            for i, c in enumerate(columns)
        ],
    )


def _around(share: float, size: int) -> list[float]:
    """Sketch percentages on both sides of a share, its error covered."""
    return [min(max(share + d, 0.0), 1.0) for d in (-2.0 / size, 2.0 / size)]


def _brackets(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], size: int,
    max_inside: int,
) -> list[dict]:
    """Per column and percentile its rank and two values around it.

    The value sought lies between them, or is the nearest one outside. The
    expected rows between are ``4 n / size``; while that is more than
    ``max_inside``, those rows are sketched again. One row per bracket reaches
    the driver.
    """
    aggs = []
    for i, c in enumerate(columns):
        points = [q for p in probs for q in _around(p, size)]
        aggs += [
            F.count(_number(c)).alias(f"n{i}"),
            F.percentile_approx(_number(c), points, size).alias(f"b{i}"),
        ]
    first = df.agg(*aggs).first()
    found = []
    for i, c in enumerate(columns):
        for j, p in enumerate(probs):
            if not first[f"n{i}"]:
                continue
            place = (first[f"n{i}"] - 1) * p
            found.append(
                {
                    "column_name": c, "prob": float(p),
                    "low": first[f"b{i}"][2 * j], "high": first[f"b{i}"][2 * j + 1],
                    "rank": math.floor(place), "part": place - math.floor(place),
                    "inside": 4 * first[f"n{i}"] / size,
                }
            )
    # each round divides the distinct values inside by size / 4; what is wide
    # after three is a few values with many copies, which merge when counted
    for _ in range(3):
        wide = [b for b in found if b["inside"] > max_inside and b["low"] < b["high"]]
        if not wide:
            break
        _narrow(df, wide, size)
    return found


def _narrow(df: DataFrame, brackets: list[dict], size: int) -> None:
    """Sketch again between the ends of each bracket; two passes."""
    counts = []
    for i, b in enumerate(brackets):
        v = _number(b["column_name"])
        counts += [
            F.count_if(v < b["low"]).alias(f"below{i}"),
            F.count_if(v.between(b["low"], b["high"])).alias(f"inside{i}"),
        ]
    seen = df.agg(*counts).first()
    aggs = []
    for i, b in enumerate(brackets):
        v = _number(b["column_name"])
        share = (b["rank"] + 0.5 - seen[f"below{i}"]) / seen[f"inside{i}"]
        kept = F.when(v.between(b["low"], b["high"]), v)
        aggs.append(F.percentile_approx(kept, _around(share, size), size).alias(f"b{i}"))
    ends = df.agg(*aggs).first()
    for i, b in enumerate(brackets):
        b["low"], b["high"] = ends[f"b{i}"]
        b["inside"] = 4 * seen[f"inside{i}"] / size


def exact_percentiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float] = QUARTILES,
    size: int = SKETCH_SIZE,
    max_inside: int = MAX_INSIDE,
) -> DataFrame:
    """``(column_name, prob, value)``, linearly interpolated.

    A sketch brackets each percentile; another pass counts what lies below and
    above and shuffles only the values inside, equal ones already merged.
    """
    brackets = df.sparkSession.createDataFrame(
        _brackets(df, columns, probs, size, max_inside),
        "column_name string, prob double, low double, high double, rank bigint, "
        "part double, inside double",
    ).drop("inside")
    values = df.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(c).alias("column_name"), _number(c).alias("value"))
                    for c in columns
                ]
            )
        )
    ).filter(F.col("value").isNotNull())
    # brackets: one row per column and percentile
    placed = values.join(F.broadcast(brackets), "column_name").withColumn(
        "zone",
        F.when(F.col("value") < F.col("low"), -1)
        .when(F.col("value") > F.col("high"), 1)
        .otherwise(0),
    )
    counted = placed.groupBy(
        "column_name", "prob", "rank", "part", "zone",
        F.when(F.col("zone") == 0, F.col("value")).alias("inside"),
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("value").alias("lowest"),
        F.max("value").alias("highest"),
    )
    order = Window.partitionBy("column_name", "prob").orderBy("zone", "inside")
    running = counted.withColumn("upto", F.sum("n").over(order))
    start = F.col("upto") - F.col("n")

    def at(rank: Column) -> Column:
        """The value of rank ``rank`` (from 0), where this row holds it."""
        here = (rank >= start) & (rank < F.col("upto"))
        outside = ((F.col("zone") == -1) & (rank != F.col("upto") - 1)) | (
            (F.col("zone") == 1) & (rank != start)
        )
        value = F.when(F.col("zone") == -1, F.col("highest")).otherwise(F.col("lowest"))
        missed = F.raise_error(F.lit("percentile fell outside its bracket"))
        return F.when(here, F.when(outside, missed.cast("double")).otherwise(value))

    ends = running.groupBy("column_name", "prob", "part").agg(
        F.max(at(F.col("rank"))).alias("below"),
        F.max(
            F.when(F.col("part") > 0, at(F.col("rank") + 1))
        ).alias("above"),
    )
    gap = F.coalesce(F.col("above") - F.col("below"), F.lit(0.0))
    return ends.select(
        "column_name", "prob", (F.col("below") + gap * F.col("part")).alias("value")
    )


def text_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column_name, count, unique, top, freq)`` of non-numeric columns.

    Values are counted by digest, so whole texts cross no shuffle. Among the
    most frequent values the one with the smallest digest is ``top``.
    """
    digest = F.md5(F.col("value").cast("binary"))
    tall = df.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("column_name"),
                        F.col(c).cast("string").alias("value"),
                    )
                    for c in columns
                ]
            )
        )
    ).filter(F.col("value").isNotNull())
    counts = tall.groupBy("column_name", digest.alias("digest")).agg(
        F.count(F.lit(1)).alias("n")
    )
    facts = counts.groupBy("column_name").agg(
        F.sum("n").alias("count"),
        F.count(F.lit(1)).alias("unique"),
        F.min(F.struct((-F.col("n")).alias("order"), "digest")).alias("best"),
    )
    best = facts.select("column_name", F.col("best.digest").alias("digest"))
    # best: one row per column
    tops = (
        tall.withColumn("digest", digest)
        .join(F.broadcast(best), ["column_name", "digest"], "left_semi")
        .groupBy("column_name")
        .agg(F.min("value").alias("top"))
    )
    return facts.join(tops, "column_name").select(
        "column_name", "count", "unique", "top", (-F.col("best.order")).alias("freq")
    )


def describe_all(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Summary of every column, one row each; what does not apply is null."""
    df = df.select(*(columns or df.columns))
    numbers, texts = columns_of(df, "numeric"), columns_of(df, "categorical")
    dates = columns_of(df, "date")
    parts = []
    if numbers:
        quartiles = (
            exact_percentiles(df, numbers)
            .groupBy("column_name")
            .agg(
                *[
                    F.max(F.when(F.col("prob") == p, F.col("value"))).alias(f"p{int(p * 100)}")
                    for p in QUARTILES
                ]
            )
        )
        parts.append(
            numeric_summary(df, numbers)
            .join(quartiles, "column_name", "left")
            .withColumn("kind", F.lit("numeric"))
        )
    if texts or dates:
        parts.append(
            text_summary(df, texts + dates).withColumn(
                "kind",
                F.when(F.col("column_name").isin(*dates), "date").otherwise(
                    "categorical"
                ) if dates else F.lit("categorical"),
            )
        )
    out = parts[0]
    for other in parts[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    wanted = {
        "column_name": "string", "kind": "string", "count": "bigint",
        "unique": "bigint", "top": "string", "freq": "bigint", "mean": "double",
        "std": "double", "min": "double", "p25": "double", "p50": "double",
        "p75": "double", "max": "double",
    }
    return out.select(
        *[
            (F.col(c) if c in out.columns else F.lit(None)).cast(t).alias(c)
            for c, t in wanted.items()
        ]
    )


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(len(df.columns)).alias("n_columns")
    )


def head_records(df: DataFrame, n: int, order_by: str) -> DataFrame:
    """The first ``n`` rows as ``(place key, JSON record)``."""
    return (
        df.orderBy(order_by)
        .limit(n)
        .select(order_by, F.to_json(F.struct(*df.columns)).alias("record"))
    )


def score_distribution(df: DataFrame, score_col: str = "Score") -> DataFrame:
    """Rows per raw score."""
    return df.groupBy(score_col).agg(F.count(F.lit(1)).alias("n"))


def label_distribution(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Rows and share per label, most frequent first."""
    counts = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
    # one row per label is left for the total
    total = F.sum("n").over(Window.partitionBy())
    return counts.withColumn("share", F.col("n") / total).orderBy(
        F.desc("n"), label_col
    )


def split_profile(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Rows per split and label; null marks a total."""
    return df.rollup("split", label_col).agg(F.count(F.lit(1)).alias("n"))
