"""Filter interaction audit: what each text filter removes, in every order in which the filters could run."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from incidence.llm.bytewords import span_hashes
from incidence.llm.common import unused

COUNTS = ("n_words", "n_distinct", "n_capitals", "n_points", "n_symbols")
SYMBOLS = "#$%&*|"

# The transducer: a byte has a class; state and class give the next state and the actions.
GAP, CAPITAL, SYMBOL, LEAD, TAIL, END = range(6)
OUTSIDE, INSIDE = range(2)
OPEN, CLOSE, POINT, UPPER, MARK = (1 << k for k in range(5))

CLASS = np.full(256, LEAD, np.uint8)
CLASS[[32, *range(9, 14)]] = GAP
CLASS[ord("A") : ord("Z") + 1] = CAPITAL
CLASS[[ord(c) for c in SYMBOLS]] = SYMBOL
CLASS[0x80:0xC0] = TAIL  # continuation bytes of UTF-8 belong to a word and start no code point

NEXT = np.array([OUTSIDE, INSIDE, INSIDE, INSIDE, INSIDE, OUTSIDE], np.uint8)  # the same from either state
_SIGNS = np.array([POINT, POINT | UPPER, POINT | MARK, POINT, 0, 0], np.uint8)
ACTION = np.stack([_SIGNS | np.where(NEXT == INSIDE, OPEN, 0), _SIGNS | np.where(NEXT == OUTSIDE, CLOSE, 0)]).astype(np.uint8)

#: Bytes that are worked on at a time; a longer text is a block of its own.
BLOCK = 1 << 20


def _ragged_equal(blob: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the `length` bytes from a and from b agree, span by span (lengths are positive)."""
    if not len(a):
        return np.zeros(0, bool)
    heads = np.r_[0, np.cumsum(length)[:-1]]
    step = np.arange(heads[-1] + length[-1]) - np.repeat(heads, length)
    differs = blob[np.repeat(a, length) + step] != blob[np.repeat(b, length) + step]
    return ~np.logical_or.reduceat(differs, heads)


def distinct_spans(blob: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Whether each span (bytes starts .. ends - 1, of text `owner`) took a new slot of the hash table.

    The table is open and probed by one slot at a time, all waiting spans at once: a free slot goes to one of the
    spans that want it, and a span at a taken slot is the same word only if the bytes and the text agree; if not, it
    moves on. Hashes alone decide nothing.
    """
    n = len(starts)
    fresh = np.zeros(n, bool)
    if not n:
        return fresh
    mask = (1 << (2 * n - 1).bit_length()) - 1
    table = np.full(mask + 1, -1, np.int64)
    length = ends - starts
    slot = ((span_hashes(blob, starts, ends - 1) ^ (owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) & np.uint64(mask)).astype(np.int64)
    waiting = np.arange(n)
    while len(waiting):
        at = slot[waiting]
        free = table[at] < 0
        table[at[free]] = waiting[free]  # of several the last stays
        holder = table[at]
        won = holder == waiting
        fresh[waiting[won]] = True
        left, holder = waiting[~won], holder[~won]
        alike = (owner[left] == owner[holder]) & (length[left] == length[holder])
        alike[alike] = _ragged_equal(blob, starts[left[alike]], starts[holder[alike]], length[left[alike]])
        waiting = left[~alike]
        slot[waiting] = (slot[waiting] + 1) & mask
    return fresh


def _scan(blob: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """COUNTS of each text cuts[i] .. cuts[i + 1] of the block, as columns."""
    n = len(cuts) - 1
    # Every text is followed by an END, which closes its last word.
    tape = np.full(len(blob) + n, END, np.uint8)
    place = np.arange(len(blob)) + np.repeat(np.arange(n), np.diff(cuts))
    tape[place] = CLASS[blob]
    state = np.r_[np.uint8(OUTSIDE), NEXT[tape[:-1]]] if len(tape) else tape
    acts = ACTION[state, tape]
    text = np.repeat(np.arange(n), np.diff(cuts) + 1)
    count = lambda flag: np.bincount(text[(acts & flag) != 0], minlength=n)
    opened, closed = np.flatnonzero(acts & OPEN), np.flatnonzero(acts & CLOSE)
    owner = text[opened]
    fresh = distinct_spans(blob, opened - owner, closed - owner, owner)
    return np.stack([np.bincount(owner, minlength=n), np.bincount(owner[fresh], minlength=n), count(UPPER), count(POINT), count(MARK)])


def scan_texts(texts: pa.Array) -> np.ndarray:
    """COUNTS of each text of a column (null: empty), as five rows; blocks of about BLOCK bytes are taken in turn."""
    column = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    parts, at = [np.zeros((len(COUNTS), 0), np.int64)], 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + BLOCK, side="right")) - 1)
        parts.append(_scan(whole[ends[at] : ends[to]], ends[at : to + 1] - ends[at]))
        at = to
    return np.concatenate(parts, axis=1)


def with_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """The columns of `df` but for `text`, and COUNTS of the text (long), each text read once by the transducer.

    A word is a run without space and tab to carriage return, distinct ones are told by their bytes; capitals are A-Z,
    points are code points. A null text is empty; clashing columns are an error.
    """
    if clash := {c.lower() for c in df.columns} & set(COUNTS):
        raise ValueError(f"columns of the counts' names: {sorted(clash)}")
    rest = [c for c in df.columns if c != text]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = scan_texts(batch[text])
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in rest), *(pa.array(v, pa.int64()) for v in found)], [*rest, *COUNTS])

    schema = df.drop(text).schema
    for name in COUNTS:
        schema = schema.add(name, "long")
    return df.mapInArrow(count, schema)


def text_failures() -> dict[str, Column]:
    """Failure conditions over COUNTS by letter: A too short, B too repetitive, C too many capitals, D symbols."""
    return {
        "A": F.col("n_words") < 200,
        "B": 100 * F.col("n_distinct") < 50 * F.col("n_words"),
        "C": 100 * F.col("n_capitals") > 2 * F.col("n_points"),
        "D": F.col("n_symbols") > 0,
    }


def interactions(
    df: DataFrame,
    labels: DataFrame,
    failures: Mapping[str, Column] | None = None,
    copies: str = "E",
    key: str = "doc_id",
    text: str = "text",
    part: str = "source",
) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: one row per part, order and step.

    Filters are the `failures` (conditions over COUNTS) and `copies`: a text that a smaller key of the table has, no
    matter which part, and whether or not that one was removed. Every order of the letters is applied from left to
    right. Texts never move: the transducer leaves flags and a digest of each; rows are summed by (digest, part, labels) before
    they meet, then by part and set of failed filters, at most 2^k sets a part, from which all orders follow.

    A null text is empty, a null part is the empty string. A null key is no smaller key and has none, so it fails
    `copies` never; rows of the smallest key don't either, however often they are repeated. A document is good (toxic)
    if any row of `labels` with its key says quality 1 (toxic 1). An empty table has no parts and gives no rows. Other
    columns of `df` are ignored.
    """
    failures = text_failures() if failures is None else dict(failures)
    letters = [*failures, copies]
    body = F.coalesce(df[text], F.lit(""))
    rows = df.select(df[key].alias("_key"), F.coalesce(df[part].cast("string"), F.lit("")).alias("_part"), F.unhex(F.sha2(body, 256)).alias("_digest"), body.alias("_text"))
    mask = sum((F.when(test, 1 << k).otherwise(0) for k, test in enumerate(failures.values())), F.lit(0))
    flagged = with_counts(rows, "_text").select("_key", "_part", "_digest", mask.alias("_mask"))
    said = labels.groupBy(F.col("doc_id").alias("_key")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("_good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("_toxic"))
    known = flagged.join(said, "_key", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("_good", "_toxic")})
    same = ["_digest", "_mask", "_part", "_good", "_toxic"]
    # Of a group of copies first the rows of each key, then the smallest key and its rows within each part.
    keyed = known.groupBy("_key", *same).agg(F.count(F.lit(1)).alias("_n"))
    cells = keyed.groupBy(*same).agg(
        F.sum("_n").alias("_n"), F.min("_key").alias("_least"), F.coalesce(F.min_by("_n", "_key"), F.lit(0)).alias("_first"), F.sum(F.when(F.col("_key").isNull(), F.col("_n")).otherwise(0)).alias("_keyless")
    )
    owner = F.min("_least").over(Window.partitionBy("_digest"))
    spared = F.col("_keyless") + F.when(F.col("_least") == owner, F.col("_first")).otherwise(0)
    parted = cells.withColumn("_spared", spared).select("_part", "_good", "_toxic", F.explode(F.array(F.struct(F.col("_mask").alias("m"), F.col("_spared").alias("n")), F.struct((F.col("_mask") + (1 << len(failures))).alias("m"), (F.col("_n") - F.col("_spared")).alias("n")))).alias("_s"))
    sets = parted.groupBy("_part", F.col("_s.m").alias("_mask"), "_good", "_toxic").agg(F.sum("_s.n").alias("_n"))
    return _over_orders(sets, letters).withColumnRenamed("_part", "part")


def _over_orders(sets: DataFrame, letters: list[str]) -> DataFrame:
    """All orders of the filters from counts of rows by (_part, _mask of failed filters, _good, _toxic).

    What a filter does depends only on the set of those that ran before it: k * 2^(k-1) pairs, counted once per part.
    The table of orders and steps is fixed by the letters alone, so it may be broadcast.
    """
    spark, k = sets.sparkSession, len(letters)
    orders = [("".join(letters[f] for f in order), step + 1, order[step], sum(1 << f for f in order[:step])) for order in itertools.permutations(range(k)) for step in range(k)]
    pairs = sorted({(f, before) for _, _, f, before in orders})
    options = F.array(*[F.struct(F.lit(f).alias("f"), F.lit(before).alias("before"), F.lit(math.factorial(b := before.bit_count()) * math.factorial(k - 1 - b)).alias("orders")) for f, before in pairs])
    spread = sets.withColumn("_o", F.explode(options)).select("*", "_o.f", "_o.before", "_o.orders")
    bit = F.get(F.array(*[F.lit(1 << i) for i in range(k)]), F.col("f"))
    fails, gone = F.col("_mask").bitwiseAND(bit) != 0, F.col("_mask").bitwiseAND(F.col("before")) != 0
    total = lambda test: F.coalesce(F.sum(F.when(test, F.col("_n"))), F.lit(0)).cast("long")
    met = spread.groupBy("_part", "f", "before", "orders").agg(
        total(~fails & ~gone).alias("kept"),
        total(fails & ~gone).alias("removed"),
        total(fails & gone).alias("redundant"),
        total(F.col("_mask") == bit).alias("unique_fails"),
        total(fails & ~gone & F.col("_good")).alias("good_lost"),
        total(fails & ~gone & F.col("_toxic")).alias("toxic_lost"),
    )
    shapley = F.sum(F.col("removed") * F.col("orders")).over(Window.partitionBy("_part", "f")).cast("long")
    table = spark.createDataFrame(orders, "filter_order string, step int, f int, before int")
    columns = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return met.withColumn("shapley", shapley).join(F.broadcast(table), ["f", "before"]).select("_part", "filter_order", "step", *columns)


def failing_rows(df: DataFrame, failures: Mapping[str, Column] | None = None, text: str = "text") -> DataFrame:
    """All columns of `df` and `failed` (the letters of the failed text filters, in their order), whatever the columns' names."""
    tests = text_failures() if failures is None else dict(failures)
    (whole, body) = unused(df, "_row", "_text")
    counted = with_counts(df.select(F.struct(*[df[c] for c in df.columns]).alias(whole), df[text].alias(body)), body)
    return counted.select(f"{whole}.*", F.concat(*[F.when(t, F.lit(c)).otherwise("") for c, t in tests.items()]).alias(unused(df, "failed")[0]))
