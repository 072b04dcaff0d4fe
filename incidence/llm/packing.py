"""Best-fit packing of token sequences by minimum bin slack."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from incidence.llm.common import lists, materialize


_LATIN, _MARKS = "A-Za-zÀ-ÖØ-öø-ɏ", r"!\"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~"


class Vocabulary:
    """Token ids of texts by the `tokenizers` library, each text as bytes of little-endian unsigned 32-bit ids.

    Texts are cut where byte-level vocabularies never join: around runs of Latin letters, of digits and of marks, around
    single newlines, and else before a space that follows a character which is no white space. So the ids of the parts
    are those of the text. A part's ids are asked of the library and kept; the KEPT parts used last, each of at most
    LONGEST characters, are known, in two generations. Words of Latin letters are asked RUN at a time, as one text with
    points between them, which are cut off by the same rules; the library's answer to a text costs more than its words.
    """

    LONGEST, KEPT, RUN = 64, 1 << 19, 256
    _WORD = re.compile(rf" ?[{_LATIN}]+")
    # A mark followed by a letter starts no contraction, as apostrophes are not among the marks; U+180E is white space
    # to some versions of Unicode.
    _PARTS = re.compile(
        rf" ?[{_LATIN}]+(?=[ \n{_MARKS}]|\Z)| ?[{_MARKS}]+(?=[{_LATIN} \n0-9]|\Z)| ?[0-9]+(?=[{_LATIN} \n{_MARKS}]|\Z)|\n(?=[^\s᠎])|.+?(?=(?<=[^\s᠎]) |\Z)", re.S
    )

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        if getattr(self.library.pre_tokenizer, "add_prefix_space", True) or self.library.normalizer is not None:
            raise ValueError("texts can be cut for byte-level vocabularies without prefix space and normalizer only")
        names = [re.escape(t.content) for t in self.library.get_added_tokens_decoder().values()]
        self.special = re.compile(f"({'|'.join(names)})") if names else None
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.point = self.library.encode(".", add_special_tokens=False).ids

    def _asked(self, parts: list[str]) -> Iterator[tuple[str, bytes]]:
        """Parts and their ids, of the library."""
        alone = []
        if len(self.point) == 1:
            words = []
            for p in parts:
                (words if self._WORD.fullmatch(p) else alone).append(p)
            runs = [words[i : i + self.RUN] for i in range(0, len(words), self.RUN)]
            for run, e in zip(runs, self.library.encode_batch_fast([".".join(run) + "." for run in runs], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, "<u4")
                ends = np.flatnonzero(ids == self.point[0]).tolist()
                if len(ends) == len(run):
                    held = ids.tobytes()
                    yield from zip(run, (held[4 * a + 4 : 4 * b] for a, b in pairwise([-1, *ends])), strict=True)
                else:  # a string of the vocabulary's own has a point in it
                    alone += run
        else:
            alone = parts
        for p, e in zip(alone, self.library.encode_batch_fast(alone, add_special_tokens=False), strict=True):
            yield p, array("I", e.ids).tobytes()

    def _parts(self, text: str) -> list[str]:
        if not self.special or not self.special.search(text):
            return self._PARTS.findall(text)
        pieces = self.special.split(text)  # the library looks for these strings first
        return [p for i, x in enumerate(pieces) for p in ([x] if i % 2 else self._PARTS.findall(x))]

    def ids(self, texts: list[str]) -> list[bytes]:
        cut = [self._parts(t) for t in texts]
        asked = []
        for p in set(chain.from_iterable(cut)).difference(self.young):
            if (known := self.old.get(p)) is None:
                asked.append(p)
            else:
                self.young[p] = known
        self.young.update(self._asked(asked))
        out = [b"".join(map(self.young.__getitem__, parts)) for parts in cut]
        for p in asked:
            if len(p) > self.LONGEST:
                del self.young[p]
        if len(self.young) > self.KEPT // 2:
            self.old, self.young = self.young, {}
        return out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


#: Characters of text that are tokenized at a time; a longer text is taken alone.
CHARACTERS = 1 << 20


def token_pieces(df: DataFrame, key: str, text: str, path: str, capacity: int, end_id: int, with_ids: bool = False) -> DataFrame:
    """key, piece, start, length, ids_crc32 (and ids): the documents' tokens with `end_id` after them, cut if over `capacity`.

    All pieces but the first are full. A null text is empty and has the end id alone. Whole texts are tokenized. Keys
    of any type, null too, pass as they are.
    """
    kinds = {"row": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()}
    end = np.array([end_id], "<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            texts = batch["_text"].fill_null("").to_pylist()
            bounds, held = [0], 0
            for i, t in enumerate(texts, 1):
                held += len(t)
                if held >= CHARACTERS or i == len(texts):
                    bounds.append(i)
                    held = 0
            for first, last in pairwise(bounds):
                rows, own = [], []
                for at, ids in enumerate(words.ids(texts[first:last]), first):
                    ids += end
                    n = len(ids) // 4
                    cut = n % capacity or capacity
                    for k, start in enumerate([0, *range(cut, n, capacity)]):
                        part = ids[4 * start : 4 * (start + (capacity if k else cut))]
                        rows.append((at, k, start, len(part) // 4, zlib.crc32(part)))
                        own += [np.frombuffer(part, "<u4")] * with_ids
                columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds.values(), strict=True)]
                out = [batch["_key"].take(columns[0]), *columns[1:], *[lists(own, pa.int32())] * with_ids]
                yield pa.RecordBatch.from_arrays(out, ["_key", *list(kinds)[1:], *["ids"] * with_ids])

    rows = df.select(df[key].alias("_key"), df[text].alias("_text"))
    kind = dict(rows.dtypes)["_key"]
    return rows.mapInArrow(pieces, f"_key {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def minimum_slack_plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths of one bin, number of such bins)]: every counted item in one bin.

    A bin starts with the longest item left. A bitset of reachable sums grows by one length at a time, longest first,
    until it holds the free space; the fullest sum's items are removed. The same bin is repeated as often as its
    lengths last, so the work depends on the number of distinct lengths and not on the number of items: each bin uses
    up a length (but for fewer than its copies in the bin), which makes at most about capacity * ln(capacity) kinds.
    """
    left = {n: c for n, c in sorted(counts.items(), reverse=True) if c > 0}
    plan = []
    while left:
        longest = next(iter(left))
        free, sums = capacity - longest, 1
        stages: list[tuple[int, int]] = []  # length, sums that the longer ones reach
        limit = (1 << (free + 1)) - 1
        for n, c in left.items():
            if n > free or sums >> free & 1:
                continue
            stages.append((n, sums))
            copies, step = min(c - (n == longest), free // n), 1
            while copies > 0:
                take = min(step, copies)
                sums |= sums << take * n & limit
                copies, step = copies - take, step * 2
        target, items = sums.bit_length() - 1, [longest]
        for n, before in reversed(stages):
            while not before >> target & 1:
                items.append(n)
                target -= n
        times = min(left[n] // items.count(n) for n in set(items))
        for n in set(items):
            left[n] -= times * items.count(n)
            if not left[n]:
                del left[n]
        plan.append((tuple(items), times))
    return plan


def plan_slots(plan: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """[(length, [(first rank, first sequence, offset)])]: where the items of a length go, by their rank among them."""
    slots: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for items, times in plan:
        offset = 0
        for n in items:
            slots.setdefault(n, []).append((used.get(n, 0), sequence, offset))
            used[n] = used.get(n, 0) + times
            offset += n
        sequence += times
    return list(slots.items())


def ranked(df: DataFrame, by: str, order: list[str], parts: int = 256) -> DataFrame:
    """Adds _rank: 0, 1, ... among the rows with equal `by`, in no stated order but the same at every run.

    Each value's rows are split in `parts` by hash and numbered there; the parts' counts, summed up, shift the numbers.
    """
    cut = df.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)))
    before = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy(by, "_part").agg(F.count(F.lit(1)).alias("_n")).select(by, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(by, "_part").orderBy(*order)
    return cut.join(starts, [by, "_part"]).withColumn("_rank", F.col("_start") + F.row_number().over(within) - 1).drop("_part", "_start")


def pack(
    df: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = 1024, end_id: int = 2, with_ids: bool = False
) -> DataFrame:
    """key, piece, start, length, ids_crc32, sequence_id, offset (and ids): every piece's place in a packed sequence.

    Spark tokenizes and counts pieces by length; the driver plans on these `capacity` counts at most; pieces find their
    slot by length and rank. Repeated keys and rows are packed like others. No rows: no sequences.
    """
    pieces = materialize(token_pieces(df, key, text, path, capacity, end_id, with_ids), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    slots = plan_slots(minimum_slack_plan(counts, capacity))
    table = df.sparkSession.createDataFrame(slots, "length long, slots array<struct<lo:long,sequence:long,offset:long>>")
    parts = max(256, sum(counts.values()) // 1_000_000)  # about a million rows of the most frequent length each
    placed = ranked(pieces, "length", ["_key", "piece", "start", "ids_crc32"], parts).join(F.broadcast(table), "length")
    slot = last_at(F.col("slots"), F.col("_rank"))
    placed = placed.withColumn("_slot", slot)
    return placed.select(
        F.col("_key").alias(key), "piece", "start", "length", "ids_crc32", (F.col("_slot.sequence") + F.col("_rank") - F.col("_slot.lo")).alias("sequence_id"), F.col("_slot.offset").alias("offset"), *["ids"] * with_ids
    )


def last_at(slots: Column, rank: Column) -> Column:
    """The last slot that starts at `rank` or before."""
    return F.element_at(F.filter(slots, lambda s: s["lo"] <= rank), -1)
