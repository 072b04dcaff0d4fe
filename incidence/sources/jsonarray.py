"""One giant JSON array as a Spark data source that can be split: byte ranges cut at the borders of the array's elements.

The elements of `[{...}, {...}, ...]` can't be told from a place in the middle of the file: a quote there may open or
close a string. So the file is read twice, both times in ranges that tasks share out. The first pass sums a range up for
each of the states in which it could begin (outside a string, inside one, behind a backslash); the driver runs the
sums in order, a few numbers per range, and knows the state and depth at every range's start. In the second pass a task
reads its range's elements: those that begin in it, so it reads on behind its end to finish the last one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PLAIN, STRING, ESCAPED = range(3)
#: Bytes that a task works on at a time.
STEP = 1 << 20
_QUOTE, _BACKSLASH = ord('"'), ord("\\")
_DEPTH = np.zeros(256, np.int64)
for _c, _d in (("{", 1), ("[", 1), ("}", -1), ("]", -1)):
    _DEPTH[ord(_c)] = _d


def outside_strings(block: np.ndarray, state: int) -> tuple[np.ndarray, int]:
    """Which bytes of the block lie outside strings (quotes count as inside), if it begins in `state`; and the state behind it."""
    n = len(block)
    if not n:
        return np.zeros(0, bool), state
    slash = block == _BACKSLASH
    # A byte is escaped if an odd run of backslashes ends before it; a run goes on from an escaped beginning.
    index = np.arange(n)
    start_of_run = np.where(slash & ~np.r_[False, slash[:-1]], index, -1)
    run = index - np.maximum.accumulate(start_of_run) + 1  # length of the run up to a backslash
    if slash[0] and state == ESCAPED:
        head = n if slash.all() else int(np.argmin(slash))
        run[:head] = index[:head]  # the first one is escaped itself
    odd = slash & (run % 2 == 1)
    escaped = np.r_[state == ESCAPED, odd[:-1]]
    quote = (block == _QUOTE) & ~escaped
    inside = (np.cumsum(quote) + (state != PLAIN)) % 2 == 1  # after the byte
    out = ~inside & ~quote
    return out, ESCAPED if odd[-1] and inside[-1] else STRING if inside[-1] else PLAIN


def summary(block: np.ndarray, state: int) -> tuple[int, int]:
    """(state behind the block, brackets opened less those closed outside strings)."""
    out, after = outside_strings(block, state)
    return after, int(_DEPTH[block[out]].sum())


@dataclass(frozen=True)
class Range:
    """Bytes start .. end - 1 of a file, and the scanner's state and depth before the first of them."""

    path: str
    start: int
    end: int
    state: int
    depth: int


def elements(read, part: Range, step: int = STEP) -> Iterator[bytes]:
    """The elements of the outermost array that begin in the range. `read(at, n)`: n bytes from `at`, fewer at the file's end.

    An element is what stands between the array's brackets and commas at depth 1; blank ones (of an empty array) are none.
    """
    at, state, depth = part.start, part.state, part.depth
    held: list[bytes] | None = None  # parts of the element that is being read
    while at < part.end or held is not None:
        block = np.frombuffer(read(at, step), np.uint8)
        if not len(block):
            if held is not None:
                raise ValueError(f"{part.path}: the array is not closed")
            return
        out, state_after = outside_strings(block, state)
        deep = depth + np.cumsum(np.where(out, _DEPTH[block], 0))
        opens = out & (deep == 1) & (block == ord("["))
        comma = out & (deep == 1) & (block == ord(","))
        closes = out & (deep == 0) & (block == ord("]"))
        last = 0
        for place in np.flatnonzero(opens | comma | closes).tolist():
            if held is not None:
                text = b"".join([*held, block[last:place].tobytes()]).strip()
                if text:
                    yield text
                held = None
            if not closes[place] and at + place < part.end:  # an element begins behind its bracket or comma
                held, last = [], place + 1
            if at + place >= part.end:
                return
        if held is not None:
            held.append(block[last:].tobytes())
        at, state, depth = at + len(block), state_after, int(deep[-1])


def _reader(spark_path: str):
    """A function (at, n) -> bytes of a file, through Arrow's file systems (local, or a store that it knows)."""
    from pyarrow import fs

    if "://" in spark_path:
        system, path = fs.FileSystem.from_uri(spark_path)
    elif spark_path.startswith("file:"):
        system, path = fs.LocalFileSystem(), spark_path.removeprefix("file:")
    else:
        system, path = fs.LocalFileSystem(), spark_path
    size = system.get_file_info(path).size
    file = system.open_input_file(path)
    return lambda at, n: file.read_at(min(n, max(0, size - at)), at) if at < size else b""


def _size(path: str) -> int:
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    info = system.get_file_info(inner)
    if info.type != fs.FileType.File:
        raise FileNotFoundError(path)
    return info.size


def ranges(spark: SparkSession, path: str, split: int = 64 << 20, step: int = STEP) -> list[Range]:
    """The file's byte ranges with the scanner's state before each: one pass over the file by tasks, some numbers per range to the driver."""
    size = _size(path)
    cuts = [(i, at, min(at + split, size)) for i, at in enumerate(range(0, size, split))]

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _reader(path)
        for batch in batches:
            rows = []
            for i, start, end in zip(*(batch[c].to_pylist() for c in ("nr", "start", "end")), strict=True):
                states, depths = [PLAIN, STRING, ESCAPED], [0, 0, 0]
                for at in range(start, end, step):
                    block = np.frombuffer(read(at, min(step, end - at)), np.uint8)
                    for s, state in enumerate(states):
                        states[s], more = summary(block, state)
                        depths[s] += more
                rows.append((i, states, depths))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[k] for r in rows], pa.list_(pa.int64())) for k in (1, 2))], ["nr", "states", "depths"])

    if not cuts:
        return []
    dealt = spark.createDataFrame(cuts, "nr long, start long, end long").repartition(len(cuts), "nr")
    found = {r["nr"]: r for r in dealt.mapInArrow(told, "nr long, states array<bigint>, depths array<bigint>").collect()}
    out, state, depth = [], PLAIN, 0
    for i, start, end in cuts:
        out.append(Range(path, start, end, state, depth))
        state, depth = found[i]["states"][state], depth + found[i]["depths"][state]
    if (state, depth) != (PLAIN, 0):
        raise ValueError(f"{path}: strings or brackets are not closed")
    return out


@dataclass
class _Part(InputPartition):
    part: Range


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.parts = [Range(options["path"], *cells) for cells in json.loads(options["ranges"])]
        self.mark, self.step = options.get("mark", "").encode("utf-8"), int(options.get("step", STEP))

    def partitions(self) -> list[_Part]:
        return [_Part(p) for p in self.parts]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for text in elements(_reader(partition.part.path), partition.part, self.step):
            if self.mark in text or b"\\" in text:  # an escape may hide the mark
                held.append(text)
                size += len(text)
            if size > STEP:
                yield _texts(held)
                held, size = [], 0
        yield _texts(held)


def _texts(held: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(held, pa.binary()).cast(pa.string())], ["value"])


class JsonArraySource(DataSource):
    """Format "jsonarray": the texts of an array's elements. Options: path, ranges (start, end, state, depth of each), mark, step."""

    @classmethod
    def name(cls) -> str:
        return "jsonarray"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema: T.StructType) -> _Reader:
        return _Reader(self.options)


def read_array(spark: SparkSession, path: str, schema: str | T.StructType, mark: str = "", split: int = 64 << 20, step: int = STEP) -> DataFrame:
    """The rows of one JSON array, read by one task per `split` bytes.

    `mark` is pushed to the source: elements whose bytes have neither it nor any escape, which could hide it, are dropped
    before they leave the scan. It may stand in any field, so callers filter by field as well. Elements that are no objects
    give rows of nulls, as Spark's own reader does; an empty file has no rows. A task holds a step of bytes, a batch of
    elements and the element at hand.
    """
    parts = ranges(spark, path, split, step)
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if not parts:
        return spark.createDataFrame([], kind)
    spark.dataSource.register(JsonArraySource)
    cells = json.dumps([(p.start, p.end, p.state, p.depth) for p in parts])
    texts = spark.read.format("jsonarray").options(path=path, ranges=cells, mark=mark, step=step).load()
    return texts.select(F.from_json("value", kind).alias("_row")).select("_row.*")
