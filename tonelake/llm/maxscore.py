"""Exact top-k search by inner product: MaxScore over postings, shard by shard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import hot_join

SCALE = 256
TOP = 5
# Vectors of a shard and queries of a block: a task holds one of each. Postings are
# built for so many vectors at a time, and bounds are raised in between.
SHARD = 8192
BLOCK = 4096
PIECE = 4096
# Sums below this are exact in double precision.
EXACT = float(1 << 53)
_LONG = (1 << 63) - 1


class Postings:
    """Lists ``(docs, weights)`` by term of some sparse integer vectors, with score bounds.

    A term that more than half of the vectors have is a whole column (docs None).
    """

    def __init__(self, vectors: list[np.ndarray]):
        self.n = len(vectors)
        sizes = [len(v) for v in vectors]
        weights = np.concatenate([*vectors, np.empty(0, np.int64)]).astype(np.int64)
        docs = np.repeat(np.arange(self.n), sizes)
        terms = np.concatenate([*map(np.arange, sizes), np.empty(0, np.int64)]).astype(np.int64)
        used = np.flatnonzero(weights)
        used = used[np.argsort(terms[used], kind="stable")]
        terms, docs, weights = terms[used], docs[used], weights[used]
        names, starts = np.unique(terms, return_index=True)
        self.lists = {}
        ends = np.append(starts, len(terms))[1:]
        for term, a, b in zip(names.tolist(), starts, ends, strict=True):
            own, held = weights[a:b], docs[a:b]
            low, high = int(own.min()), int(own.max())
            if b - a < self.n:  # the others have a weight of 0
                low, high = min(low, 0), max(high, 0)
            values = own.astype(np.float64)
            if 2 * (b - a) > self.n:
                column = np.zeros(self.n)
                column[held] = values
                held, values = None, column
            self.lists[term] = (low, high, held, values, own, docs[a:b])

    def _exactly(self, query: list[tuple[int, int]]) -> np.ndarray:
        """All scores in Python's integers, where doubles might round; held inside a long."""
        scores = np.zeros(self.n, object)
        for term, weight in query:
            _, _, _, _, own, docs = self.lists[term]
            scores[docs] += own.astype(object) * weight
        return np.clip(scores, -_LONG - 1, _LONG).astype(np.int64)

    def search(self, query: list[tuple[int, int]], bound: float) -> tuple[np.ndarray, np.ndarray]:
        """Vectors that score ``bound`` or more, and their scores.

        ``query`` lists terms and weights. Terms in order of what they can add at most: those
        that together stay below the bound are non-essential, as no vector reaches it by
        them alone. Postings of the others are added up; then the non-essential terms, the
        strongest first, are looked up for those vectors that can still reach the bound.
        """
        lists = self.lists
        query = [(term, weight) for term, weight in query if term in lists]
        most = sorted(
            (max(weight * lists[term][0], weight * lists[term][1]), term, weight)
            for term, weight in query
        )
        size = sum(abs(w) * max(abs(lists[t][0]), abs(lists[t][1])) for t, w in query)
        if size >= EXACT:
            scores = self._exactly(query)
            found = np.flatnonzero(scores >= bound)
            return found, scores[found]
        rest, split = 0, 0
        while split < len(most) and rest + most[split][0] < bound:
            rest += most[split][0]
            split += 1
        scores = np.zeros(self.n)
        # without essential terms a vector scores 0 at most
        every = bound <= 0
        seen = None if every else np.zeros(self.n, bool)
        for _, term, weight in most[split:]:
            _, _, docs, values, _, _ = lists[term]
            if docs is None:
                scores += weight * values
                every = True
            else:
                scores[docs] += weight * values
                if not every:
                    seen[docs] = True
        reach = scores + rest >= bound
        alive = np.flatnonzero(reach if every else reach & seen)
        for adds, term, weight in reversed(most[:split]):
            if not len(alive):
                break
            _, _, docs, values, _, _ = lists[term]
            rest -= adds
            if docs is None:
                got = scores[alive] + weight * values[alive]
            else:
                at = np.minimum(np.searchsorted(docs, alive), len(docs) - 1)
                got = scores[alive] + np.where(docs[at] == alive, weight * values[at], 0.0)
            scores[alive] = got
            alive = alive[got + rest >= bound]
        return alive, scores[alive].astype(np.int64)


def _order(hit: tuple) -> tuple:
    """Higher scores first, then smaller ids, those without last."""
    score, key, row = hit
    return (-score, key is None, key or 0, row)


def _search_cells(top: int):
    """Best ``top`` rows of a shard for each query of a block; a query's rows come last."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
        name, vectors, queries = None, [], []
        for batch in batches:
            for row in batch.to_pylist():
                if (row["shard"], row["block"]) != name:
                    if vectors and queries:
                        yield vectors, queries
                    name, vectors, queries = (row["shard"], row["block"]), [], []
                (queries if row["asks"] else vectors).append(row)
        if vectors and queries:
            yield vectors, queries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("ask", pa.string()), ("score", pa.int64()), ("vec_id", pa.int64()), ("row", pa.int64())])
        for vectors, queries in cells(batches):
            asked = []
            for row in queries:
                terms = [(t, w) for t, w in enumerate(row["weights"]) if w]
                bound = -np.inf if row["bound"] is None else row["bound"]
                asked.append([row["key"], terms, bound, []])
            for at in range(0, len(vectors), PIECE):
                part = vectors[at : at + PIECE]
                index = Postings([np.array(v["weights"], np.int64) for v in part])
                for query in asked:
                    _, terms, bound, best = query
                    found, scores = index.search(terms, bound)
                    if len(found) > 4 * top:  # ties with the last one stay
                        least = np.partition(scores, -top)[-top]
                        found, scores = found[scores >= least], scores[scores >= least]
                    hits = [
                        (score, own["vec_id"], own["row"])
                        for doc, score in zip(found.tolist(), scores.tolist(), strict=True)
                        for own in part[doc]["holders"]
                    ]
                    query[3] = best = sorted(best + hits, key=_order)[:top]
                    if len(best) == top:
                        query[2] = max(bound, best[-1][0])
            rows = [(ask, *hit) for ask, _, _, best in asked for hit in best]
            columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds
            )

    return run


def _cells(vectors: DataFrame, queries: DataFrame, shards: Column, blocks: int) -> DataFrame:
    """Shards and blocks of queries brought together, a shard's vectors first."""
    block = F.pmod(F.xxhash64("key", F.lit("block")), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    holders = "array<struct<vec_id:long,row:long>>"
    rows = vectors.select(
        "shard", every.alias("block"), F.lit(False).alias("asks"), "key", "weights", "holders",
        F.lit(None).cast("long").alias("bound"),
    ).unionByName(
        queries.select(
            F.explode(shards).alias("shard"), block.alias("block"), F.lit(True).alias("asks"),
            "key", "weights", F.lit(None).cast(holders).alias("holders"), "bound",
        )
    )
    return rows.repartition("shard", "block").sortWithinPartitions("shard", "block", "asks")


def top_k(
    vectors: DataFrame,
    asks: Column,
    k: int = TOP,
    scale: int = SCALE,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    shard_rows: int = SHARD,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best other rows of each row that ``asks``.

    A component x counts as ``floor(scale * x)``, x in double precision, held inside a long;
    the score is the inner product of these integers, exact (held inside a long too). Ties go
    to the smaller id, null ids last. A query has fewer results where there are fewer rows.

    Vectors that are null or hold null or non-finite components take no part. Empty
    vectors score 0 with all, and of two lengths the shorter one is filled up with zeros. Every row is
    a row: repeated rows and ids are found, and ask, one by one. An empty table gives no rows.
    Other columns may have any name.

    Equal vectors are searched, and asked for, once. Vectors are dealt to shards
    of about ``shard_rows``. The first shard is searched without a bound, and its ``k + 1``-th
    score is a bound for all others, which give only what reaches it; so each query carries
    a few rows from each shard. What is merged is a few rows a shard, cut by rank before and after
    the shuffle. No cap on candidates: bounds alone leave them out.
    """
    spark = vectors.sparkSession
    top = k + 1  # a row that asks finds itself
    numbers = F.col(vector_col).cast("array<double>")
    good = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter(F.col(vector_col).isNotNull() & good).select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.coalesce(asks, F.lit(False)).alias("asks"),
        F.transform(numbers, lambda x: F.floor(x * float(scale))).alias("weights"),
    )
    rows = rows.withColumn("key", F.md5(F.concat_ws(",", F.col("weights").cast("array<string>"))))
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    # the first holders of each vector; a vector that very many rows have is cut before the shuffle
    first = Window.partitionBy("key").orderBy(F.col("vec_id").asc_nulls_last(), "row")
    holders = (
        rows.select("key", "vec_id", "row")
        .withColumn("at", F.row_number().over(first))
        .filter(F.col("at") <= top)
        .groupBy("key")
        .agg(F.collect_list(F.struct("vec_id", "row")).alias("holders"))
    )
    classes = rows.groupBy("key").agg(F.first("weights").alias("weights"), F.bool_or("asks").alias("asks"))
    classes = materialize(classes.join(holders, "key"), "vector-classes")
    n, n_asks = classes.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-n_asks // BLOCK))
    placed = classes.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))
    asked = classes.filter("asks").select("key", "weights", F.lit(None).cast("long").alias("bound"))
    kinds = "ask string, score long, vec_id long, row long"
    search = _search_cells(top)
    one = F.array(F.lit(0))
    found = materialize(
        _cells(placed.filter("shard = 0"), asked, one, blocks).mapInArrow(search, kinds), "first-hits"
    )
    if shards > 1:
        bounds = found.groupBy("ask").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
        bounds = bounds.select(F.col("ask").alias("key"), F.when(F.col("n") >= top, F.col("least")).alias("bound"))
        asked = asked.drop("bound").join(bounds, "key", "left")
        others = F.sequence(F.lit(1), F.lit(shards - 1))
        more = _cells(placed.filter("shard > 0"), asked, others, blocks).mapInArrow(search, kinds)
        found = found.unionByName(more)
    order = Window.partitionBy("ask").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "row")
    hits = F.sort_array(F.collect_list(F.struct("at", "vec_id", "row", "score")))
    best = (
        found.withColumn("at", F.row_number().over(order))
        .filter(F.col("at") <= top)
        .groupBy(F.col("ask").alias("key"))
        .agg(hits.alias("hits"))
    )
    best = materialize(best, "best-hits")
    asking = rows.filter("asks").select("key", F.col("vec_id").alias("query_id"), F.col("row").alias("own"))
    others = F.filter("hits", lambda h: h["row"] != F.col("own"))
    answers = hot_join(asking, best, ["key"], ["own"])
    answers = answers.select("query_id", F.posexplode(F.slice(others, 1, k)).alias("at", "hit"))
    return answers.select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score")
    )
