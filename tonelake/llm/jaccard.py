"""Texts that share most of their word n-grams, found along chosen paths."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import batch_words, hot_join, maybe_in, shingle_set, text_batches
from .graph import components

WORDS = 5
SIMILARITY = 0.8
TARGET_RECALL = 0.99999
# Tokens kept of each set, those of least hash, and how many a step chooses on average.
SAMPLE = 64
CHOSEN = 2.5
# Buckets up to this size are compared at once; larger ones are split, or compared in
# blocks of the second size.
BUCKET = 64
BLOCK = 1024
MAX_DEPTH = 8
# A bucket whose members share so much of their samples on average isn't split any more;
# so many hashes tell it, of about so many members. Dense buckets are put together by so many draws
# of two members. Of buckets up to the size ``WHOLE`` less is asked: to compare those in blocks makes
# fewer rows than to split them, as members that share a third or more of their samples go on in as many buckets.
DENSE = 0.3
LIKE = 0.12
WHOLE = 8 * BLOCK
MARKS = 6
JUDGED = 256
DRAWS = 16


def runs_for(recall: float, similarity: float = SIMILARITY) -> int:
    """Runs after which a pair at the threshold is missed with probability ``1 - recall``.

    A pair shares ``CHOSEN * similarity`` chosen tokens a step on average (Poisson), each a bucket
    that both go on in. The pair survives any number of steps with the
    probability s = 1 - exp(-CHOSEN * similarity * s).
    """
    survives = 1.0
    for _ in range(200):
        survives = 1 - math.exp(-CHOSEN * similarity * survives)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - survives)))


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, words: int = WORDS) -> DataFrame:
    """``doc_id, row_key, sid, n, sample`` of every row.

    ``sid`` names the set of word n-grams (a 64-bit hash), ``n`` is its size and
    ``sample`` its ``SAMPLE`` tokens of least hash. ``row_key`` is a hash of id and text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = (
            pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["k", "t"])
            for b in (x.select(["key", "text"]) for x in batches)
        )
        for keys, texts in text_batches(pairs):
            found, at = batch_words(texts)
            sids, sizes, samples = [], [], []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                tokens = shingle_set(found[a:b], words)
                digest = hashlib.blake2b(tokens.tobytes(), digest_size=8).digest()
                sids.append(int.from_bytes(digest, "little", signed=True))
                sizes.append(len(tokens))
                samples.append(tokens[:SAMPLE].astype(np.uint32).view(np.int32))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array([k["doc_id"] for k in keys], pa.int64()),
                    "row_key": pa.array([k["row_key"] for k in keys], pa.int64()),
                    "sid": pa.array(sids, pa.int64()),
                    "n": pa.array(sizes, pa.int32()),
                    "sample": pa.array(samples, pa.list_(pa.int32())),
                }
            )

    key = F.struct(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("row_key"))
    rows = docs.select(key.alias("key"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, row_key long, sid long, n int, sample array<int>")


def row_key(id_col: str, text_col: str) -> Column:
    doc = F.col(id_col).cast("long")
    return F.xxhash64(doc.isNull(), doc, F.col(text_col).cast("string"))


def _chosen(seed: Column, sample: Column) -> Column:
    """The buckets that a sample's chosen tokens lead to from ``seed``."""
    chance = F.lit(CHOSEN) / F.greatest(F.size(sample), F.lit(1))
    draw = lambda t: F.pmod(F.xxhash64(seed, t), F.lit(1 << 30)) < chance * (1 << 30)
    return F.transform(F.filter(sample, draw), lambda t: F.xxhash64(seed, t, F.lit("path")))


def _grows(table: DataFrame) -> DataFrame:
    """A side of a join that grows with the corpus: shuffled at any size, never broadcast."""
    return table.hint("merge")


def _split(classes: DataFrame, runs: int) -> DataFrame:
    """Buckets to compare: ``path, size`` and each member's ``sid``.

    Every step puts the members of a bucket into the buckets of their chosen tokens.
    Buckets of one are dropped, and of buckets with the same members one is kept.
    Large ones are split again, unless ``MAX_DEPTH`` is reached or they are dense, which is told
    before their members go on; then they are compared in blocks, so no pair is lost by it.
    The many dense buckets that one group of near copies falls into are put together first.
    """
    sets = classes.filter("n > 0").select("sid", "sample")
    starts = F.flatten(F.transform(F.array(*[F.lit(r) for r in range(runs)]), lambda r: _chosen(r, F.col("sample"))))
    members = sets.select("sid", F.explode(F.array_distinct(starts)).alias("path"))
    done: list[DataFrame] = []
    dense: list[DataFrame] = []
    for depth in range(MAX_DEPTH + 1):
        members = materialize(members, "members")
        counted = members.groupBy("path").agg(
            F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("sid")).alias("names")
        )
        kept = counted.filter("size > 1").groupBy("size", "names").agg(F.min("path").alias("path"))
        kept = materialize(kept.select("path", "size"), "kept-buckets")
        rows = maybe_in(members, kept, "path")
        held = materialize(rows.join(_grows(kept), "path"), "buckets")
        if depth == MAX_DEPTH:
            done.append(held)
            break
        done.append(held.filter(F.col("size") <= BUCKET))
        parents = held.filter(F.col("size") > BUCKET)
        if parents.isEmpty():
            break
        crowded = materialize(_dense(sets, parents), "dense-buckets")
        dense.append(parents.join(crowded, "path", "left_semi").select("path", "sid"))
        # a sample travels once for each member, not once for each of its buckets, and
        # later steps read those that are still in some large bucket that is split
        whose = parents.join(crowded, "path", "left_anti").groupBy("sid").agg(F.collect_list("path").alias("parents"))
        sets = materialize(
            maybe_in(sets.select("sid", "sample"), whose, "sid").join(_grows(whose), "sid"), "live-sets"
        )
        members = sets.select("sid", "sample", F.explode("parents").alias("path")).select(
            "sid", F.explode(F.array_distinct(_chosen(F.col("path"), F.col("sample")))).alias("path")
        )
    out = _union([part.select("path", "sid", "size") for part in done])
    return out.unionByName(_merged(_union(dense))) if dense else out


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _dense(sets: DataFrame, parents: DataFrame) -> DataFrame:
    """Paths of buckets in which two members share ``DENSE`` of their tokens on average, ``LIKE`` if they fit ``WHOLE``.

    Two sets have the same token of least hash as often as they share one, so
    squared counts by that token tell it, of a few hashes. A bucket is judged by about ``JUDGED`` members
    drawn by hash, so that a large one costs no more; that decides how its pairs are found, not which.
    """
    judged = parents.filter(F.pmod(F.xxhash64("path", "sid", F.lit("judge")), F.col("size")) < JUDGED)
    least = lambda j: F.array_min(
        F.transform("sample", lambda t: F.xxhash64(F.lit(j), F.col("path"), t))
    )
    drawn = maybe_in(sets.select("sid", "sample"), judged, "sid").join(_grows(judged), "sid")
    drawn = materialize(drawn.select("path", "size", *[least(j).alias(f"mark{j}") for j in range(MARKS)]), "judged")
    marks = _union([drawn.select("path", "size", F.col(f"mark{j}").alias("mark")) for j in range(MARKS)])
    counts = marks.groupBy("path", "size", "mark").agg(F.count(F.lit(1)).alias("n"))
    shares = counts.groupBy("path", "size").agg(
        F.sum(F.col("n") * F.col("n")).alias("pairs"), F.sum("n").alias("rows")
    )
    asked = F.when(F.col("size") <= WHOLE, F.lit(LIKE)).otherwise(F.lit(DENSE))
    return shares.filter(F.col("pairs") * MARKS >= asked * F.col("rows") * F.col("rows")).select("path")


def _merged(dense: DataFrame) -> DataFrame:
    """Dense buckets of one group as one bucket that holds the members of all.

    Those that agree in two members of least hash, in any of some draws, have most
    of their members in common. Buckets of a group that miss each other are compared
    each on its own, so that what is put together costs less and decides nothing.
    """
    dense = materialize(dense, "dense-members")
    least = lambda j: F.min(F.xxhash64("sid", F.lit(j)))
    names = dense.groupBy("path").agg(
        F.array(*[F.xxhash64(F.lit(j), least(2 * j), least(2 * j + 1)) for j in range(DRAWS)]).alias("names")
    )
    links = names.select(F.col("path").alias("a"), F.explode("names").alias("b"))
    roots = components(links).withColumnRenamed("node", "path")
    together = dense.join(_grows(roots), "path").select(F.col("root").alias("path"), "sid").distinct()
    together = materialize(together, "dense-groups")
    sizes = together.groupBy("path").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    return hot_join(together, materialize(sizes, "dense-sizes"), ["path"], ["sid"]).select("path", "sid", "size")


# --- comparing a bucket -------------------------------------------------------


def _shared(lists: list[np.ndarray], cells: int = 1 << 22) -> np.ndarray:
    """How many values each two of some lists of distinct values share."""
    n = len(lists)
    sizes = [len(x) for x in lists]
    out = np.zeros((n, n), np.float32)
    values = np.concatenate(lists) if n else np.empty(0)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.concatenate([[True], values[1:] != values[:-1]])[: len(values)]
    column = np.cumsum(new) - 1
    often = np.bincount(column, minlength=1)[column] > 1 if len(column) else column.astype(bool)
    column, owner = column[often], owner[often]
    if not len(column):
        return out
    column = np.cumsum(np.concatenate([[0], column[1:] != column[:-1]]))
    wide = max(1, cells // n)
    for start in range(0, int(column[-1]) + 1, wide):
        a, b = np.searchsorted(column, [start, start + wide])
        table = np.zeros((n, min(wide, int(column[b - 1]) - start + 1)), np.float32)
        table[owner[a:b], column[a:b] - start] = 1
        out += table @ table.T
    return out


def _to_compare(path: int, sides: np.ndarray, paths: list[np.ndarray]) -> np.ndarray:
    """Pairs (above the diagonal) for which this is the first bucket that they share.

    In a pair of two blocks, only pairs across them.
    """
    n = len(paths)
    mask = np.triu(np.ones((n, n), bool), 1)
    if sides.min() != sides.max():
        mask &= sides[:, None] != sides[None, :]
    before = [p[p < path] for p in paths]
    return mask & (_shared(before) == 0)


def _local_roots(pairs: np.ndarray) -> np.ndarray:
    """Smallest index that each row reaches along true pairs."""
    linked = pairs | pairs.T
    root = np.arange(len(pairs))
    while True:
        best = np.where(linked, root[None, :], len(root)).min(1)
        new = np.minimum(root, best)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """Rows that follow each other with the same keys."""
    name, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            own = tuple(row[k] for k in keys)
            if own != name and held:
                yield name, held
                held = []
            name = own
            held.append(row)
    if held:
        yield name, held


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of each bucket whose samples make a pair of the threshold possible.

    Two sets of similarity 0.8 share 8 ninths of their tokens on average of both, so of
    64 of least hash more than 50 are expected to be shared; half, 5 deviations
    less, is asked for. Whole small sets of that similarity share more than half too, and one more, should two
    tokens of one be alike in the bits that are sent.
    """
    out: dict[str, list] = {"path": [], "i": [], "j": [], "part": [], "side": [], "sid": [], "row_key": [], "copies": [], "paths": []}
    for (path, i, j), rows in _groups(batches, ["path", "i", "j"]):
        if len(rows) < 2:
            continue
        samples = [np.array(r["sample"], np.int16) for r in rows]
        size = np.array([len(s) for s in samples])
        paths = [np.array(r["paths"], np.int64) for r in rows]
        pairs = 2 * _shared([np.unique(s) for s in samples]) >= np.maximum(size[:, None], size[None, :]) - 1
        pairs &= _to_compare(path, np.array([r["side"] for r in rows]), paths)
        if not pairs.any():
            continue
        roots = _local_roots(pairs)
        involved = pairs.any(0) | pairs.any(1)
        for n in np.flatnonzero(involved).tolist():
            row = rows[n]
            values = (path, i, j, int(roots[n]), row["side"], row["sid"], row["row_key"], row["copies"], row["paths"])
            for column, value in zip(out.values(), values, strict=True):
                column.append(value)
        if len(out["path"]) > 2000:
            yield pa.RecordBatch.from_pydict(out, CANDIDATES)
            out = {name: [] for name in out}
    yield pa.RecordBatch.from_pydict(out, CANDIDATES)


CANDIDATES = pa.schema(
    [
        ("path", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("part", pa.int32()),
        ("side", pa.int32()), ("sid", pa.int64()), ("row_key", pa.int64()), ("copies", pa.int64()),
        ("paths", pa.list_(pa.int64())),
    ]
)


def _links(words: int, similarity: float):
    """Exact links within each group of candidates: counts, and a tie to the group's first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("sid", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])
        for (path, *_), rows in _groups(batches, ["path", "i", "j", "part"]):
            if len(rows) < 2:
                continue
            found, at = batch_words([r["text"] for r in rows])
            sets = [shingle_set(found[a:b], words) for a, b in zip(at[:-1], at[1:], strict=True)]
            size = np.array([len(s) for s in sets], np.float64)
            both = _shared(sets).astype(np.float64)
            either = size[:, None] + size[None, :] - both
            paths = [np.array(r["paths"], np.int64) for r in rows]
            pairs = both >= similarity * either - 1e-9
            pairs &= _to_compare(path, np.array([r["side"] for r in rows]), paths)
            if not pairs.any():
                continue
            copies = np.array([r["copies"] for r in rows], np.int64)
            links = (pairs | pairs.T) @ copies
            roots = _local_roots(pairs)
            own = np.flatnonzero(links).tolist()
            yield pa.RecordBatch.from_pydict(
                {
                    "sid": [rows[n]["sid"] for n in own],
                    "root": [rows[roots[n]]["sid"] for n in own],
                    "links": [int(links[n]) for n in own],
                },
                kinds,
            )

    return run


def near_copies(
    docs: DataFrame,
    similarity: float = SIMILARITY,
    words: int = WORDS,
    recall: float = TARGET_RECALL,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Group of every row: ``doc_id, row_key, class_id, n_links, kept``.

    Two rows are linked if the sets of their runs of ``words`` words (a text of fewer
    words is one run) have a Jaccard similarity of ``similarity`` or more. ``n_links``
    counts the other rows linked directly, ``class_id`` is the least id that is
    reachable by links, and ``kept`` is true for the one row key of each class that
    stands for it (least id, nulls last; ``row_key`` is a hash of id and text, so rows
    alike in both are kept or not together).

    Rows with the same set are one member with a weight, so copies make no pairs. Members
    go along chosen paths (``_split``), in so many runs that a pair at the threshold is missed with
    probability ``1 - recall``, and one of higher similarity less often.
    In a bucket, samples rule out what can't be similar, then the sets
    themselves are compared. A pair counts in the first bucket it shares only. A bucket
    of many near copies is compared block by block, each two blocks a task,
    and gives counts and a spanning tree, never its pairs.

    A text without words (null, empty, signs only) links with nothing and stays. Null
    ids have no part in ``class_id`` unless a class has no other. An empty
    table gives no rows.
    """
    rows = materialize(shingle_sets(docs, id_col, text_col, words), "shingle-sets")
    classes = materialize(
        rows.groupBy("sid").agg(
            F.count(F.lit(1)).alias("copies"),
            F.first("n").alias("n"),
            F.first("sample").alias("sample"),
            F.min("row_key").alias("row_key"),
            F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("least"),
        ),
        "shingle-classes",
    )
    buckets = materialize(_split(classes, runs_for(recall, similarity)), "paths")
    # every member with all its buckets; 15 bits of a token do to rule out what shares too few
    short = F.transform("sample", lambda t: t.bitwiseAND(0x7FFF).cast("smallint")).alias("sample")
    cards = (
        buckets.groupBy("sid")
        .agg(F.sort_array(F.collect_set("path")).alias("paths"))
        .join(
            _grows(maybe_in(classes.select("sid", "copies", short, "row_key"), buckets, "sid")),
            "sid",
        )
    )
    big = buckets.filter(F.col("size") > BLOCK).select("path", "size").distinct()
    big = big.select("path", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    placed = cards.withColumn("path", F.explode("paths")).join(big, "path", "left")
    blocks = F.coalesce("blocks", F.lit(1))
    placed = placed.withColumn("blocks", blocks).withColumn(
        "side", F.pmod(F.xxhash64("path", "sid"), F.col("blocks")).cast("int")
    )
    # of the other buckets only those before this one are asked for
    before = F.filter("paths", lambda p: p < F.col("path")).alias("paths")
    placed = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "path", F.least("side", "with").alias("i"), F.greatest("side", "with").alias("j"),
        "side", "sid", "row_key", "copies", "sample", before,
    )
    grouped = placed.repartition("path", "i", "j").sortWithinPartitions("path", "i", "j")
    kinds = (
        "path long, i int, j int, part int, side int, sid long, row_key long, copies long,"
        " paths array<long>"
    )
    found = materialize(grouped.mapInArrow(_candidates, kinds), "candidates")
    wanted = found.select("row_key").distinct()
    keyed = docs.select(row_key(id_col, text_col).alias("row_key"), F.col(text_col).cast("string").alias("text"))
    texts = (
        maybe_in(keyed, wanted, "row_key")
        .join(_grows(wanted), "row_key", "left_semi")
        .groupBy("row_key")
        .agg(F.first("text").alias("text"))
    )
    together = (
        found.join(_grows(texts), "row_key")
        .select("path", "i", "j", "part", "side", "sid", "copies", "paths", "text")
        .repartition("path", "i", "j", "part")
        .sortWithinPartitions("path", "i", "j", "part")
    )
    links = materialize(
        together.mapInArrow(_links(words, similarity), "sid long, root long, links long"), "links"
    )
    roots = components(links.select(F.col("sid").alias("a"), F.col("root").alias("b")))
    counted = links.groupBy("sid").agg(F.sum("links").alias("links"))
    named = (
        classes.select("sid", "copies", "least")
        .join(_grows(roots.withColumnRenamed("node", "sid")), "sid", "left")
        .join(_grows(counted), "sid", "left")
    )
    named = materialize(named, "named-classes")
    # only a set with links is looked up, any other is the first of its class; a class of very many members is shared out
    linked = named.filter("root is not null")
    firsts = materialize(linked.groupBy("root").agg(F.min("least").alias("first")), "class-firsts")
    unlinked = named.filter("root is null").withColumn("first", F.col("least"))
    named = _union([
        part.select("sid", "first", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
        for part in (hot_join(linked, firsts, ["root"], ["sid"]), unlinked)
    ])
    alone = F.col("n") == 0
    return rows.drop("sample").join(_grows(named), "sid").select(
        "doc_id",
        "row_key",
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"),
        F.when(alone, F.lit(0)).otherwise(F.col("links")).cast("long").alias("n_links"),
        (alone | (F.col("row_key") == F.col("first.row_key"))).alias("kept"),
    )


def keep_one_of_each(
    docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One document of each class of ``near_copies``, with all its columns.

    Of rows alike in id and text the one whose other columns are least stays.
    """
    kept = near_copies(docs, similarity, id_col=id_col, text_col=text_col).filter("kept")
    keys = kept.select(F.col("row_key").alias("__row")).distinct()
    keyed = docs.withColumn("__row", row_key(id_col, text_col))
    least = F.min(F.struct(*docs.columns)).alias("__least")
    return keyed.join(keys, "__row", "left_semi").groupBy("__row").agg(least).select("__least.*")
