"""Near copies among embedding vectors by NN-descent."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .graph import components
from .jaccard import _groups

COSINE = 0.95
# Neighbours a node lists at first, and once its list is full of links.
LIST, LONG_LIST = 8, 32
# Pairs below this cosine lead to no link in one step, as both their angles would be
# over half of its angle; they aren't listed.
REACH = 0.8
# Tables of planes at least; see ``_tables_for``.
TABLES = 12
BLOCK = 256
ROUNDS = 4
# Nodes audited at least, and so many times the square root of their number.
AUDITED, AUDITED_ROOTS = 2000, 2
TARGET_RECALL = 0.99


def vector_nodes(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, node, dims, vec`` of every row that can link.

    ``vec`` holds doubles scaled to length 1. Rows with equal direction in double
    precision are one node, named by its hash. Null or zero vectors and those with
    null or non-finite components are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"vec_id": [], "dims": [], "vec": []}
            for key, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not row or any(x is None for x in row):
                    continue
                values = np.array(row, np.float64)
                top = np.abs(values).max()
                if not np.isfinite(top) or top == 0:
                    continue
                values = values / top  # so squares neither vanish nor overflow
                values /= np.sqrt(values @ values)
                out["vec_id"].append(key)
                out["dims"].append(len(values))
                out["vec"].append(values.tobytes())
            yield pa.RecordBatch.from_pydict(
                out, pa.schema([("vec_id", pa.int64()), ("dims", pa.int32()), ("vec", pa.binary())])
            )

    rows = table.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")
    ).mapInArrow(run, "vec_id long, dims int, vec binary")
    return rows.withColumn("node", F.xxhash64("vec")).select("vec_id", "node", "dims", "vec")


def _matrix(rows: list[dict]) -> np.ndarray:
    return np.frombuffer(b"".join(r["vec"] for r in rows), np.float64).reshape(len(rows), -1)


def _bits(n: int) -> int:
    return min(24, max(4, int(n / (BLOCK / 2)).bit_length()))


def _tables_for(n: int, recall: float = TARGET_RECALL) -> int:
    """Tables in which two of ``n`` nodes at cosine ``COSINE`` share a bucket, but for half of what ``recall`` leaves.

    Such a pair has no other way to be found, if neither has more neighbours. The other half
    is for pairs parted by the windows of a bucket.
    """
    same = (1 - np.arccos(COSINE) / np.pi) ** _bits(n)
    return max(TABLES, int(np.ceil(np.log(max(1 - recall, 1e-9) / 2) / np.log1p(-same))))


def _first_lists(nodes: DataFrame, tables: int, bits: int, seed: int, size: int) -> DataFrame:
    """Neighbours within blocks of vectors that fall on the same side of random planes.

    Rows are sorted by table of planes, bits and a projection; each task compares
    runs of ``BLOCK`` rows in that order, half overlapping, so a bucket of any size costs
    in proportion to its rows. ``_bits`` makes buckets of about half a block, were they even.
    """

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = np.array(batch.column(1))
            rows = np.arange(len(dims))
            vecs = batch.column(2).to_pylist()
            for d in np.unique(dims).tolist():
                own = rows[dims == d]
                if d not in planes:
                    draw = np.random.default_rng([seed, d])
                    planes[d] = draw.standard_normal((d, (bits + 1) * tables))
                x = np.frombuffer(b"".join(vecs[n] for n in own.tolist()), np.float64).reshape(-1, d)
                side = x @ planes[d]
                for t in range(tables):
                    at = (bits + 1) * t
                    code = (side[:, at : at + bits] > 0) @ (1 << np.arange(bits))
                    yield pa.RecordBatch.from_pydict(
                        {
                            "t": pa.array(np.full(len(own), t), pa.int32()),
                            "dims": batch.column(1).take(pa.array(own)),
                            "code": pa.array(code, pa.int32()),
                            "along": side[:, at + bits],
                            "node": batch.column(0).take(pa.array(own)),
                            "vec": pa.array([vecs[n] for n in own.tolist()], pa.binary()),
                        }
                    )

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _windows(batches):
            yield _top(_matrix(rows), np.array([r["node"] for r in rows]), size)

    schema = "t int, dims int, code int, along double, node long, vec binary"
    order = ["t", "dims", "code", "along", "node"]
    coded = nodes.select("node", "dims", "vec").mapInArrow(codes, schema)
    dealt = coded.repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.mapInArrow(near, "a long, b long, cosine double")


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[dict]]]:
    """Runs of at most ``BLOCK`` rows of the same table and bits, half overlapping."""
    name, held, fresh = None, [], 0
    for batch in batches:
        for row in batch.to_pylist():
            own = (row["t"], row["dims"], row["code"])
            if own != name or len(held) == BLOCK:
                if len(held) > 1 and fresh:
                    yield name, held
                held = held[BLOCK // 2 :] if own == name else []
                name, fresh = own, 0
            held.append(row)
            fresh += 1
    if len(held) > 1 and fresh:
        yield name, held


def _top(x: np.ndarray, nodes: np.ndarray, size: int, floor: np.ndarray | None = None) -> pa.RecordBatch:
    """For each node, the ``size`` nearest others of a block from ``REACH`` up, both ways."""
    cosine = x @ x.T
    np.fill_diagonal(cosine, -2)
    size = min(size, len(nodes) - 1)
    best = np.argpartition(-cosine, size - 1, axis=1)[:, :size]
    value = np.take_along_axis(cosine, best, 1)
    good = value >= REACH
    if floor is not None:
        good &= value > floor[:, None]
    a = np.repeat(np.arange(len(nodes)), size)[good.ravel()]
    return pa.RecordBatch.from_pydict(
        {"a": nodes[a], "b": nodes[best.ravel()[good.ravel()]], "cosine": value.ravel()[good.ravel()]}
    )


def _merge(lists: DataFrame) -> DataFrame:
    """The nearest neighbours of each node: ``LIST``, or ``LONG_LIST`` if all those are links.

    Spark limits each node's rows by rank in every task before they are shuffled, so
    a node named by very many others stays small.
    """
    pairs = lists.groupBy("a", "b").agg(F.max("cosine").alias("cosine"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cosine"), "b"))
    near = (
        pairs.withColumn("rank", rank)
        .filter(F.col("rank") <= LONG_LIST)
        .groupBy("a")
        .agg(F.sort_array(F.collect_list(F.struct("cosine", "b")), False).alias("near"))
    )
    full = F.element_at("near", F.least(F.lit(LIST), F.size("near")))["cosine"] >= COSINE
    return near.select("a", F.when(full, F.col("near")).otherwise(F.slice("near", 1, LIST)).alias("near"))


def _improve(lists: DataFrame, nodes: DataFrame, turn: int) -> DataFrame:
    """Compare neighbours of a node with each other, and give what betters some list.

    Every node sends its vector to those it lists; at each of these, those that came
    and the node itself are compared in blocks. A node that very many list has
    many blocks, each of ``BLOCK`` rows, dealt by a hash that differs from ``turn`` to ``turn``.
    """
    edges = lists.select("a", F.explode("near.b").alias("b"))
    last = F.element_at("near", -1)["cosine"]
    # a list of links may still grow, up to the longer length
    done = (F.size("near") >= LONG_LIST) | ((F.size("near") >= LIST) & (last < COSINE))
    floors = lists.select(F.col("a").alias("node"), F.when(done, last).alias("floor"))
    meet = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    crowd = meet.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    own = crowd.select("b", F.col("b").alias("a"), "blocks")
    dealt = meet.join(crowd, "b").select("b", "a", "blocks").union(own.select("b", "a", "blocks"))
    dealt = dealt.select("b", "a", F.pmod(F.xxhash64("a", "b", F.lit(turn)), F.col("blocks")).cast("int").alias("block"))
    full = nodes.select("node", "dims", "vec").join(floors, "node", "left")
    rows = dealt.join(full.withColumnRenamed("node", "a"), "a").select("b", "block", "a", "vec", "floor")
    rows = rows.repartition("b", "block").sortWithinPartitions("b", "block", "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _groups(batches, ["b", "block"]):
            if len(held) > 1:
                floor = np.array([-1.0 if r["floor"] is None else r["floor"] for r in held])
                yield _top(_matrix(held), np.array([r["a"] for r in held]), LONG_LIST, floor)

    return rows.mapInArrow(run, "a long, b long, cosine double")


def _full_groups(linked: DataFrame, nodes: DataFrame) -> DataFrame:
    """Exact links of the nodes of some components, block against block.

    ``linked`` has ``node, root, copies``. A component of n nodes takes (n / BLOCK)² / 2 tasks
    of two blocks each; out come counts, not pairs.
    """
    sizes = linked.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    placed = linked.join(sizes, "root").withColumn("side", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = (
        placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("root", F.least("side", "with").alias("i"), F.greatest("side", "with").alias("j"), "side", "node", "copies")
        .join(nodes.select("node", "vec"), "node")
        .repartition("root", "i", "j")
        .sortWithinPartitions("root", "i", "j")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), rows in _groups(batches, ["root", "i", "j"]):
            x = _matrix(rows)
            pairs = x @ x.T >= COSINE
            np.fill_diagonal(pairs, False)
            if i != j:
                side = np.array([r["side"] for r in rows])
                pairs &= side[:, None] != side[None, :]
            links = pairs @ np.array([r["copies"] for r in rows], np.int64)
            yield pa.RecordBatch.from_pydict({"node": [r["node"] for r in rows], "links": links})

    return placed.mapInArrow(run, "node long, links long")


def _balls(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes of some components, each in a ball of at most ``BLOCK`` nodes around one of them.

    ``members`` has ``node, root``. Columns ``ball`` (its centre's hash), ``root, node, centre, radius``;
    the radius, an angle, is the largest in the ball and at most half of a link's.
    """
    chunks = members.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / (4 * BLOCK)).cast("int").alias("chunks"))
    rows = members.join(chunks, "root").select(
        "root", "node", F.pmod(F.xxhash64("node", F.lit("ball")), F.col("chunks")).cast("int").alias("chunk")
    )
    rows = rows.join(nodes.select("node", "dims", "vec"), "node").repartition("root", "chunk").sortWithinPartitions("root", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (root, _), held in _groups(batches, ["root", "chunk"]):
            x, left = _matrix(held), np.arange(len(held))
            while len(left):
                angle = np.arccos(np.clip(x[left] @ x[left[0]], -1, 1))
                angle[0] = 0
                own = np.argsort(angle, kind="stable")[:BLOCK]
                own = own[angle[own] <= np.arccos(COSINE) / 2]
                at, centre = left[own], held[left[0]]
                yield pa.RecordBatch.from_pydict(
                    {
                        "ball": pa.array([centre["node"]] * len(at), pa.int64()),
                        "root": pa.array([root] * len(at), pa.int64()),
                        "node": pa.array([held[n]["node"] for n in at.tolist()], pa.int64()),
                        "dims": pa.array([centre["dims"]] * len(at), pa.int32()),
                        "centre": pa.array([bytes(centre["vec"])] * len(at), pa.binary()),
                        "radius": np.full(len(at), angle[own].max()),
                    }
                )
                left = np.delete(left, own)

    return rows.mapInArrow(run, "ball long, root long, node long, dims int, centre binary, radius double")


def _across(inside: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Exact links between nodes of different components, and the components they join.

    ``inside`` has ``node, root, copies``. Lists cut at ``LONG_LIST`` may hold none of these links, where
    each node has as many nearer ones of its own component. Nodes are gathered in
    balls; two balls can hold a link only if the angle of their centres is at most that of a
    link and both radii, and only members of such balls are compared.
    Out come counts, ``node, links``, and pairs of roots, ``a, b``.
    """
    members = materialize(_balls(inside.select("node", "root"), nodes), "vector-balls")
    balls = members.select("ball", "root", "dims", F.col("centre").alias("vec"), "radius").distinct()
    sides = 4 * BLOCK
    sizes = balls.groupBy("dims").agg(F.ceil(F.count(F.lit(1)) / sides).cast("int").alias("blocks"))
    placed = balls.join(sizes, "dims").withColumn("side", F.pmod(F.xxhash64("ball"), F.col("blocks")).cast("int"))
    placed = (
        placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumns({"i": F.least("side", "with"), "j": F.greatest("side", "with")})
        .select("dims", "i", "j", "side", "ball", "root", "vec", "radius")
        .repartition("dims", "i", "j")
        .sortWithinPartitions("dims", "i", "j")
    )

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), rows in _groups(batches, ["dims", "i", "j"]):
            x = _matrix(rows)
            ball, root, side = (np.array([r[c] for r in rows]) for c in ("ball", "root", "side"))
            radius = np.array([r["radius"] for r in rows])
            reach = np.arccos(COSINE) + radius[:, None] + radius[None, :] + 1e-6
            meet = (np.arccos(np.clip(x @ x.T, -1, 1)) <= reach) & (root[:, None] != root[None, :])
            meet &= ball[:, None] < ball[None, :]
            if i != j:
                meet &= side[:, None] != side[None, :]
            a, b = np.nonzero(meet)
            yield pa.RecordBatch.from_pydict({"a": ball[a], "b": ball[b]})

    pairs = placed.mapInArrow(near, "a long, b long")
    pairs = materialize(pairs, "vector-ball-pairs")
    ends = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("ball"))
    rows = (
        ends.join(members.select("ball", "root", "node"), "ball")
        .join(inside.select("node", "copies"), "node")
        .join(nodes.select("node", "vec"), "node")
        .select("a", "b", "root", "node", "copies", "vec")
        .repartition("a", "b")
        .sortWithinPartitions("a", "b")
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _groups(batches, ["a", "b"]):
            x = _matrix(held)
            root, node = (np.array([r[c] for r in held]) for c in ("root", "node"))
            linked = (x @ x.T >= COSINE) & (root[:, None] != root[None, :])
            links = linked @ np.array([r["copies"] for r in held], np.int64)
            own = links > 0
            if own.any():
                yield pa.RecordBatch.from_pydict(
                    {
                        "node": node[own],
                        "links": links[own],
                        "a": np.full(own.sum(), root.min()),
                        "b": np.full(own.sum(), root.max()),
                    }
                )

    found = materialize(rows.mapInArrow(count, "node long, links long, a long, b long"), "vector-across")
    return found.select("node", "links"), found.select("a", "b").distinct()


def audit_links(nodes: DataFrame, counts: DataFrame, asked: int = AUDITED) -> tuple[float, int]:
    """Mean share of its links that ``counts`` has, over those of ``asked`` nodes that have any, and their number.

    The asked nodes are those of least hash, and are compared with all rows by brute force. Each weighs
    the same, whether it has one link or thousands. Where none has a link, the share is 1.
    """
    queries = nodes.orderBy(F.xxhash64("node", F.lit("audit"))).limit(asked).select("node", "dims", "vec").collect()
    if not queries:
        return 1.0, 0
    spread = nodes.sparkSession.sparkContext.broadcast([(r["node"], r["dims"], bytes(r["vec"])) for r in queries])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.array(batch.column(1))
            names, copies = np.array(batch.column(0)), np.array(batch.column(3))
            vecs = batch.column(2).to_pylist()
            for d in np.unique(dims).tolist():
                own = np.flatnonzero(dims == d)
                asked_rows = [q for q in spread.value if q[1] == d]
                if not asked_rows:
                    continue
                x = np.frombuffer(b"".join(vecs[n] for n in own.tolist()), np.float64).reshape(-1, d)
                q = np.frombuffer(b"".join(v for _, _, v in asked_rows), np.float64).reshape(-1, d)
                keys = np.array([n for n, _, _ in asked_rows])
                linked = (q @ x.T >= COSINE) & (keys[:, None] != names[own][None, :])
                yield pa.RecordBatch.from_pydict({"node": keys, "links": linked @ copies[own]})

    true = nodes.select("node", "dims", "vec", "copies").mapInArrow(run, "node long, links long")
    true = true.groupBy("node").agg(F.sum("links").alias("true")).filter(F.col("true") > 0)
    got = F.least("true", F.coalesce("links", F.lit(0))) / F.col("true")
    both = true.join(counts, "node", "left").agg(F.avg(got).alias("share"), F.count(F.lit(1)).alias("n")).first()
    return (both["share"], both["n"]) if both["n"] else (1.0, 0)


def near_vectors(
    table: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    target_recall: float = TARGET_RECALL,
    max_tries: int = 3,
) -> DataFrame:
    """Near copies of every vector: ``vec_id, n_links, component_id, kept``.

    Two rows link if their cosine, in double precision, is ``COSINE`` or more. NN-descent
    finds them: neighbour lists start from blocks of vectors on the same side of
    random planes; then, round after round, neighbours of a node are
    compared with each other until few lists improve. A list full of links is
    made longer (``LIST`` to ``LONG_LIST``); components that have a list still full are
    counted exactly, block by block, and compared with each other, as full lists may hold no link
    that leaves the component. At last ``audit_links`` compares
    a sample of nodes, which grows with the square root of their number, with all rows; below
    ``target_recall`` the search goes on with more planes, and the last of ``max_tries`` searches
    raises if it is still below. The tables of planes are so many that a lone pair meets.

    Equal vectors are one node with a weight, so copies make no pairs. Null or zero vectors,
    and ones with null or non-finite components, link with nothing and are kept. Vectors of other
    lengths don't link. Every row comes back; repeated ids count as rows
    of their own. An empty table gives no rows.
    """
    rows = materialize(vector_nodes(table, id_col, vec_col), "vectors")
    nodes = materialize(
        rows.groupBy("node", "dims", "vec").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least")),
        "vector-nodes",
    )
    n = nodes.count()
    asked = max(AUDITED, int(AUDITED_ROOTS * n**0.5))
    tables = _tables_for(n, target_recall)
    lists = None
    for attempt in range(max_tries):
        found = _first_lists(nodes, tables, _bits(n), attempt, LIST if attempt == 0 else LONG_LIST)
        if lists is not None:
            found = found.union(lists.select("a", F.explode("near").alias("n")).select("a", "n.b", "n.cosine"))
        lists = materialize(_merge(found), "lists")
        for turn in range(ROUNDS):
            better = _improve(lists, nodes, attempt * ROUNDS + turn)
            old = lists.select("a", F.explode("near").alias("n")).select("a", F.col("n.b").alias("b"), F.col("n.cosine").alias("cosine"))
            new = materialize(_merge(old.union(better)), "lists")
            changed = new.join(lists.withColumnRenamed("near", "old"), "a", "left").filter(
                F.col("old").isNull() | (F.size(F.array_except("near.b", F.coalesce("old.b", F.array().cast("array<long>")))) > 0)
            ).count()
            total = new.count()
            lists = new
            if changed <= 0.001 * total:
                break
        counts, roots = _count_links(lists, nodes)
        recall, linked = audit_links(nodes, counts, asked)
        if recall >= target_recall:
            break
    else:
        raise RuntimeError(f"recall {recall:.4f} of {linked} audited nodes is below {target_recall} after {max_tries} searches")
    named = (
        nodes.select("node", "copies", "least")
        .join(counts, "node", "left")
        .join(roots, "node", "left")
        .withColumn("root", F.coalesce("root", "node"))
    )
    firsts = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(firsts, "root").select(
        "node", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    linked = rows.select("vec_id", "node").join(named, "node").select("vec_id", "n_links", "component_id")
    valid = _valid(F.col(vec_col).cast("array<double>"))
    rest = table.filter(~F.coalesce(valid, F.lit(False))).select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.lit(0).cast("long").alias("n_links"),
        F.col(id_col).cast("long").alias("component_id"),
    )
    return linked.union(rest).select(
        "vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def _valid(vec):
    finite = F.forall(vec, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return finite & F.exists(vec, lambda x: x != 0)


def _count_links(lists: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links of each node (rows it is linked with), and its component."""
    ties = lists.select("a", F.size("near").alias("held"), F.explode("near").alias("n")).filter(F.col("n.cosine") >= COSINE)
    pairs = materialize(
        ties.select(F.least("a", "n.b").alias("a"), F.greatest("a", "n.b").alias("b")).distinct(), "vector-links"
    )
    roots = materialize(components(pairs), "vector-roots")
    copies = nodes.select(F.col("node").alias("b"), "copies")
    both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    listed = both.join(copies, "b").groupBy("a").agg(F.sum("copies").alias("links")).withColumnRenamed("a", "node")
    full = lists.filter(
        (F.size("near") >= LONG_LIST) & (F.element_at("near", -1)["cosine"] >= COSINE)
    ).select(F.col("a").alias("node"))
    crowded = roots.join(full, "node").select("root").distinct()
    inside = roots.join(crowded, "root", "left_semi").join(nodes.select("node", "copies"), "node")
    inside = materialize(inside, "vector-crowded")
    across, joined = _across(inside, nodes)
    exact = _full_groups(inside, nodes).union(across).groupBy("node").agg(F.sum("links").alias("exact"))
    counts = listed.join(exact, "node", "full_outer").select(
        "node", F.coalesce("exact", "links").alias("links")
    )
    merged = components(joined).select(F.col("node").alias("root"), F.col("root").alias("whole"))
    roots = roots.join(merged, "root", "left").select("node", F.coalesce("whole", "root").alias("root"))
    return materialize(counts, "vector-counts"), materialize(roots, "vector-whole-roots")
