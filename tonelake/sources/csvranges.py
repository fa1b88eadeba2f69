"""CSV records of several lines, read by as many tasks as a file has ranges.

Spark splits a text file between lines. Whether a line begins inside a quoted field
depends on all lines before it, but what a run of lines makes of either beginning is a
function of two states, and such functions can be put together range by range. So one pass
finds the function of every range, a fold over the ranges the state each begins in, and a second pass
cuts records, which ``from_csv`` parses.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize

# Options with which records end elsewhere, or that only the file reader knows
WHOLE_FILE = {
    "escape", "linesep", "encoding", "charset", "comment", "multiline", "header", "inferschema",
    "chartoescapequoteescaping", "unescapedquotehandling", "pathglobfilter", "recursivefilelookup",
    "ignoreleadingwhitespace",
}


def can_split(options: Mapping[str, str | bool] | None) -> bool:
    """Whether records can be found range by range under these CSV options."""
    given = {k.lower(): str(v) for k, v in (options or {}).items()}
    separator = given.get("sep", given.get("delimiter", ","))
    return (
        not WHOLE_FILE & given.keys()
        and given.get("mode", "FAILFAST").upper() in ("FAILFAST", "PERMISSIVE")
        and len(separator) == 1
        and len(given.get("quote", '"')) == 1
        and separator != given.get("quote", '"')
    )


class Lines:
    """How lines act on the state 'inside a quoted field'.

    A field is quoted if its first character is a quote; a doubled quote inside is one
    character. Other quotes are plain characters, so counting them isn't enough.
    """

    def __init__(self, quote: str, separator: str):
        q, s = re.escape(quote), re.escape(separator)
        quoted = f"{q}(?:[^{q}]|{q}{q})*{q}(?:[^{q}{s}][^{s}]*)?"
        plain = f"(?:[^{q}{s}][^{s}]*)?"
        self.quote = quote
        # all fields of the line that end, then one that is still open
        self.open_end = rf"\A(?:(?:{quoted}|{plain}){s})*{q}(?:[^{q}]|{q}{q})*\z"

    def ends(self, lines: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lines with a quote, and whether each ends inside a field: begun outside, begun inside."""
        held = np.flatnonzero(pc.match_substring(lines, self.quote).to_numpy(zero_copy_only=False))
        some = lines.take(pa.array(held))
        test = lambda a: pc.match_substring_regex(a, self.open_end).to_numpy(zero_copy_only=False)
        begun = pc.binary_join_element_wise(pa.scalar(self.quote), some, pa.scalar(""))
        return held, test(some).astype(bool), test(begun).astype(bool)

    def states(self, lines: pa.Array, inside: bool) -> np.ndarray:
        """Whether each line begins inside a field, and at last whether the next one does."""
        n = len(lines)
        held, outside_ends, inside_ends = self.ends(lines)
        fixed = outside_ends == inside_ends
        turns = np.cumsum(outside_ends & ~inside_ends)
        # the last line that ends alike from either state decides, turned by those after it
        last = np.maximum.accumulate(np.where(fixed, np.arange(len(held)), -1))
        known = last >= 0
        base = np.where(known, outside_ends[last] if len(held) else False, inside)
        since = turns - np.where(known, turns[last] if len(held) else 0, 0)
        after = base ^ (since % 2 == 1)
        out = np.empty(n + 1, bool)
        out[0] = inside
        at = np.searchsorted(held, np.arange(n), "right") - 1
        out[1:] = np.where(at >= 0, after[at] if len(held) else inside, inside)
        return out


def _range_parts(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple]:
    """``(key, columns)`` of the stretches of batches that lie in one range."""
    for batch in batches:
        key = np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names])
        cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            if b > a:
                yield tuple(int(x) for x in key[:, a]), batch.slice(a, b - a)


def _range_functions(lines: Lines):
    """The state after a range, by the state before it, and whether a record begins in it
    where it begins inside one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict[tuple, tuple[bool, bool, bool]] = {}
        for key, part in _range_parts(batches, ("file", "start")):
            outside, inside, begun = now.get(key, (False, True, False))
            states = [lines.states(part.column("value"), s) for s in (False, True)]
            begun = begun or not states[inside][:-1].all()
            now[key] = (bool(states[outside][-1]), bool(states[inside][-1]), begun)
        columns = list(zip(*[(*k, *v) for k, v in now.items()], strict=True)) or [()] * 5
        kinds = [pa.int64()] * 2 + [pa.bool_()] * 3
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
            names=["file", "start", "outside", "inside", "reopens"],
        )

    return run


def _range_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``file, start, state, owner`` of the sorted ranges: the state a range begins in, and
    where the range lies in which the record that is open there begins."""
    file, state, owner = None, False, 0
    for batch in batches:
        out: dict[str, list] = {"file": [], "start": [], "state": [], "owner": []}
        for row in batch.to_pylist():
            if row["file"] != file:
                file, state, owner = row["file"], False, row["start"]
            if not state:
                owner = row["start"]
            for name, value in zip(out, (file, row["start"], state, owner), strict=True):
                out[name].append(value)
            # a record that is closed and another that is open at the end begins in this range
            if state and row["reopens"]:
                owner = row["start"]
            state = row["inside"] if state else row["outside"]
        yield pa.RecordBatch.from_pydict(
            {
                "file": pa.array(out["file"], pa.int64()),
                "start": pa.array(out["start"], pa.int64()),
                "state": pa.array(out["state"], pa.bool_()),
                "owner": pa.array(out["owner"], pa.int64()),
            }
        )


class _Cutter:
    """Cuts the lines of one range, which come in parts, into records."""

    def __init__(self, lines: Lines, start: int, inside: bool, owner: int):
        self.lines, self.start, self.inside, self.owner = lines, start, inside, owner
        self.held: list[str] = []
        self.continued = inside
        self.first = start == 0
        self.pieces: list[tuple] = []

    def feed(self, values: pa.Array) -> list[pa.Array]:
        """Records, but a file's first, that are known to end with these lines or before."""
        states = self.lines.states(values, self.inside)
        self.inside = bool(states[-1])
        begins = np.flatnonzero(~states[:-1])
        lead = int(begins[0]) if len(begins) else len(values)
        self.held += values.slice(0, lead).to_pylist()
        if not len(begins):
            return []
        out = self._finish()
        cuts = pa.array(np.append(begins, len(values)).astype(np.int32))
        texts = pc.binary_join(pa.ListArray.from_arrays(cuts, values), "\n")
        # the last one may go on
        self.held = values.slice(int(begins[-1])).to_pylist()
        texts = texts.slice(0, len(texts) - 1)
        if self.first and len(texts):
            self.first, texts = False, texts.slice(1)
        return [*out, texts]

    def _finish(self) -> list[pa.Array]:
        text, self.held = "\n".join(self.held) if self.held else None, []
        if text is None:
            return []
        if self.continued:
            self.continued = False
            self.pieces.append((self.owner, self.start, False, text))
            return []
        if self.first:
            self.first = False
            return []
        return [pa.array([text], pa.string())]

    def close(self) -> list[pa.Array]:
        if not self.inside or not self.held:
            return self._finish()
        owner = self.owner if self.continued else self.start
        self.pieces.append((owner, self.start, self.first and not self.continued, "\n".join(self.held)))
        return []


def _cut(lines: Lines, wants_pieces: bool):
    """Records that lie in one range; or, as pieces, those that lie in several."""

    def texts(arrays: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        for a in arrays if not wants_pieces else []:
            a = pc.replace_substring_regex(a, r"\r\z", "")
            yield pa.RecordBatch.from_arrays([a], names=["record"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, cutter, pieces = None, None, []
        for own, part in _range_parts(batches, ("file", "start", "state", "owner")):
            if own != key:
                if cutter:
                    yield from texts(cutter.close())
                    pieces += [(key[0], *p) for p in cutter.pieces]
                key, cutter = own, _Cutter(lines, own[1], bool(own[2]), own[3])
            yield from texts(cutter.feed(part.column("value")))
        if cutter:
            yield from texts(cutter.close())
            pieces += [(key[0], *p) for p in cutter.pieces]
        if wants_pieces:
            columns = list(zip(*pieces, strict=True)) or [()] * len(_PIECES)
            arrays = [pa.array(c, f.type) for c, f in zip(columns, _PIECES, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=_PIECES)

    return run


_PIECES = pa.schema(
    [
        ("file", pa.int64()), ("owner", pa.int64()), ("start", pa.int64()), ("first", pa.bool_()),
        ("text", pa.string()),
    ]
)


def csv_records(
    spark: SparkSession, path: str, quote: str = '"', separator: str = ","
) -> DataFrame:
    """``record``: the text of each record but the first of each file, the header.

    Lines end at LF or CRLF, files are UTF-8; CRLF inside a field stays as it is. Blank lines
    outside of a record are none. Lines are read
    twice and never shuffled; a third time, for the records that lie across ranges, where there are any.
    What is broadcast is a row for each range of ``spark.sql.files.maxPartitionBytes``, not for data.
    """
    cutter = Lines(quote, separator)
    read = spark.read.option("lineSep", "\n").text(path)
    lines = read.select(
        "value",
        F.xxhash64("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
    )
    ranges = lines.mapInArrow(
        _range_functions(cutter), "file long, start long, outside boolean, inside boolean, reopens boolean"
    )
    ordered = ranges.repartition("file").sortWithinPartitions("file", "start")
    states = materialize(
        ordered.mapInArrow(_range_states, "file long, start long, state boolean, owner long"), "csv-ranges"
    )
    known = lines.join(F.broadcast(states), ["file", "start"]).select(
        "value", "file", "start", F.col("state").cast("long").alias("state"), "owner"
    )
    records = known.mapInArrow(_cut(cutter, False), "record string")
    if not states.filter("state").isEmpty():
        schema = "file long, owner long, start long, first boolean, text string"
        pieces = known.mapInArrow(_cut(cutter, True), schema)
        together = F.sort_array(F.collect_list(F.struct("start", "text")))["text"]
        joined = pieces.groupBy("file", "owner").agg(
            F.array_join(together, "\n").alias("record"), F.bool_or("first").alias("first")
        )
        joined = joined.filter("NOT first").select(F.regexp_replace("record", "\r\\z", "").alias("record"))
        records = records.unionByName(joined)
    return records.filter(F.col("record") != "")


def read_csv_ranges(
    spark: SparkSession, path: str, columns: list[str], options: Mapping[str, str | bool]
) -> DataFrame:
    """String columns of CSV files with a header line, parsed by Spark's own ``from_csv``."""
    given = {k.lower(): str(v) for k, v in options.items()}
    records = csv_records(
        spark, path, given.get("quote", '"'), given.get("sep", given.get("delimiter", ","))
    )
    names = [c.replace("`", "``") for c in columns]
    schema = ", ".join(f"`{c}` STRING" for c in names)
    parsed = {"mode": "FAILFAST", "escape": '"', **options, "multiLine": "true"}
    row = F.from_csv("record", schema, {k: str(v) for k, v in parsed.items()})
    return records.select(row.alias("row")).select(*[F.col(f"row.`{c}`") for c in names])
