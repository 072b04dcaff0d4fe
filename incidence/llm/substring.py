"""Substring dedup by seed and extend over word sequences.

Seeds are winnowed anchors: of every `window` words the k-gram with the smallest hash, so that equal windows have equal
anchors. Documents meet on anchors that more than one of them has. Each place of a shared anchor is extended both ways,
word by word, along a place of the same anchor in a document with a smaller key; matches of at least `window` words are
repeats, and overlapping repeats merge into maximal spans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incidence.llm.bytewords import blocks
from incidence.llm.common import WHITES, lists, materialize, splitmix

#: Two odd factors for polynomial hashes modulo 2^64; odd numbers have inverses there.
FACTORS = (0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93)


class Rolling:
    """Hashes of all runs of `size` words of a document, from prefix sums of word hash times factor^place."""

    def __init__(self, factor: int):
        self.factor, self.inverse = factor, pow(factor, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            self.up, self.down = (np.cumprod(np.r_[np.uint64(1), np.full(n - 1, f, np.uint64)], dtype=np.uint64) for f in (self.factor, self.inverse))

    def prefix(self, words: np.ndarray) -> np.ndarray:
        self.powers(len(words) + 1)
        return np.r_[np.uint64(0), np.cumsum(words * self.up[: len(words)], dtype=np.uint64)]

    def runs(self, prefix: np.ndarray, size: int) -> np.ndarray:
        n = len(prefix) - size
        return splitmix((prefix[size:] - prefix[:n]) * self.down[:n])


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """Minimum or maximum (`pick`) of every run of `width` values, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = pick(x[: len(x) - step], x[step:])
        done += step
    return x


def anchors(grams: np.ndarray, width: int) -> np.ndarray:
    """Places that hold the smallest hash of some run of `width` hashes (all of equal ones)."""
    if len(grams) < width:
        return np.zeros(0, np.int64)
    least = _slide(grams, width, np.minimum)
    edge = np.zeros(width - 1, np.uint64)
    return np.flatnonzero(_slide(np.r_[edge, least, edge], width, np.maximum) == grams)


class Seeder:
    """A task's hashes, from word hashes to anchors."""

    def __init__(self, window: int, gram: int):
        self.window, self.gram = window, gram
        self.one, self.two = map(Rolling, FACTORS)

    def seeds(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Prefix sums, places of anchors, hashes of anchors."""
        prefix = self.one.prefix(words)
        if len(words) < self.window:
            return prefix, np.zeros(0, np.int64), np.zeros(0, np.int64)
        grams = self.one.runs(prefix, self.gram)
        at = anchors(grams, self.window - self.gram + 1)
        return prefix, at, grams[at].view(np.int64)


#: Contexts of an anchor that one task extends; of anchors that have more, windows meet by hash.
CHUNK = 1 << 16
#: Documents whose hashes (8 bytes each) are sent to every task, so that the texts of no others are moved to meet what is known of them.
FEW_DOCUMENTS = 1 << 22
#: Shared anchors (8 bytes each) that are sent to every task, so that the documents' anchors need not move to meet them.
FEW_ANCHORS = 1 << 22
#: Contexts that are compared at a time.
ROWS = 1 << 14
#: Contexts whose windows are worked out at a time.
SLICE = 512
#: Times by which a task's branches may outgrow its contexts before their windows are compared instead.
BRANCHING = 4
_PLACE = "seed long, _key long, _id binary, place int, before int, after int, context binary"


def _equal_words(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each row the number of equal words at the start; 0 is no word."""
    differ = (a != b) | (a == 0)
    return np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])


def _grown(left: np.ndarray, right: np.ndarray, row: np.ndarray, along: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words by which the places `row` can be extended to the left and to the right along the places `along`."""
    parts = [slice(i, i + ROWS) for i in range(0, len(row), ROWS)]
    return tuple(np.concatenate([_equal_words(side[row[p]], side[along[p]]) for p in parts] or [np.zeros(0, np.int64)]) for side in (left, right))


def _branches(group: np.ndarray, left: np.ndarray, right: np.ndarray, l: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:  # noqa: E741
    """(position, group): the groups in which places may grow beyond l and r along others of their group.

    Two places that grow along the smallest one by different numbers of words on a side are equal there for the lesser
    number only, which the smallest one has told already. So only places with the same number and the same next word
    on that side must meet again.
    """
    at, groups = [], []
    for side, (words, n) in enumerate(((left, l), (right, r))):
        open_ = np.flatnonzero(n < words.shape[1])
        following = words[open_, n[open_]]
        open_, following = open_[following != 0], following[following != 0]
        at.append(open_)
        groups.append(splitmix(splitmix(group[open_] ^ following) + (2 * n[open_] + side + 1).astype(np.uint64)))
    return np.concatenate(at), np.concatenate(groups)


def _classes(group: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each row the first one of its group with the same context."""
    mixed = group.copy()
    for side in (left, right):
        for j in range(side.shape[1]):
            mixed = splitmix(mixed ^ side[:, j])
    order = np.lexsort((np.arange(len(group)), mixed, group))
    same = group[order][1:] == group[order][:-1]
    for side in (left, right):
        same &= np.concatenate([(side[order[i + 1 : i + 1 + ROWS]] == side[order[i : i + ROWS][: len(order) - 1 - i]]).all(axis=1) for i in range(0, len(order) - 1, ROWS)] or [same[:0]])
    starts = np.flatnonzero(np.r_[True, ~same])
    head = np.empty(len(group), np.int64)
    head[order] = order[starts][np.cumsum(np.r_[True, ~same]) - 1]
    return head


def _prefixes(words: np.ndarray) -> np.ndarray:
    """Hashes of the first 0, 1, ... words of each row."""
    out = np.zeros((len(words), words.shape[1] + 1), np.uint64)
    for j in range(words.shape[1]):
        out[:, j + 1] = splitmix(out[:, j] + words[:, j] + np.uint64(0x9E3779B97F4A7C15))
    return out


def _windows(left: np.ndarray, right: np.ndarray, around: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(l, rows, hash of the l words before, hash of the words after) for each window that holds an anchor."""
    own_l, own_r = np.count_nonzero(left, axis=1), np.count_nonzero(right, axis=1)
    before, after = _prefixes(left), _prefixes(right)
    for l in range(around + 1):  # noqa: E741
        rows = np.flatnonzero((own_l >= l) & (own_r >= around - l))
        yield l, rows, before[rows, l], after[rows, around - l]


def _by_windows(group: np.ndarray, key: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, l, r) of all windows that a smaller key of the group has too, by their hashes; rows are sorted by key in a group."""
    found, around = [], left.shape[1]
    for l, rows, one, two in _windows(left, right, around):  # noqa: E741
        order = np.lexsort((rows, two, one, group[rows]))
        same = np.r_[False, (group[rows][order][1:] == group[rows][order][:-1]) & (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])]
        head = rows[order][np.flatnonzero(~same)[np.cumsum(~same) - 1]] if len(rows) else rows
        hit = rows[order][key[rows[order]] > key[head]]
        found.append((hit, np.full(len(hit), l), np.full(len(hit), around - l)))
    return found


def extend(group: np.ndarray, key: np.ndarray, left: np.ndarray, right: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, l, r): the repeats of `window` words at least that places make with smaller keys, l words before and r after their anchor.

    Rows are sorted by group and key. Places with equal contexts are settled by the first of them, and have its repeats
    if they have its key. A group's contexts are extended along its first one, and where some of them may agree with
    each other beyond that, in branches of the group, until nothing is left to compare. In texts that go round in
    circles branches multiply; the windows of what is left then are compared by hash, all of a group at once.
    """
    if not len(group):
        return (np.zeros(0, np.int64),) * 3
    head = _classes(group, left, right)
    own_l, own_r = np.count_nonzero(left, axis=1), np.count_nonzero(right, axis=1)
    later = np.flatnonzero((key > key[head]) & (own_l + gram + own_r >= window))
    whole, found = (later, own_l[later], own_r[later]), []
    heads = np.flatnonzero(head == np.arange(len(head)))
    row, root = heads, group
    group = group[row]
    while len(row):
        if len(row) > BRANCHING * len(heads):
            rest = heads[np.isin(root[heads], root[row])]
            found += [(rest[at], l, r) for at, l, r in _by_windows(root[rest], key[rest], left[rest], right[rest])]  # noqa: E741
            break
        fresh = np.r_[True, group[1:] != group[:-1]]
        first = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        low, high = key[row[first]], np.maximum.reduceat(key[row], np.flatnonzero(fresh))[np.cumsum(fresh) - 1]
        useful = (low < high) & (np.arange(len(row)) != first)
        row, group, along = row[useful], group[useful], row[first][useful]
        l, r = _grown(left, right, row, along)  # noqa: E741
        hit = (key[row] > key[along]) & (l + gram + r >= window)
        found.append((row[hit], l[hit], r[hit]))
        at, branch = _branches(group, left[row], right[row], l, r)
        order = np.lexsort((row[at], branch))
        row, group = row[at][order], branch[order]
    told = [np.concatenate([f[i] for f in found] or [np.zeros(0, np.int64)]) for i in range(3)]
    # What a context has, all places with it have that have its key.
    members = np.flatnonzero(key == key[head])
    members = members[np.argsort(head[members], kind="stable")]
    from_, to = (np.searchsorted(head[members], told[0], side=s) for s in ("left", "right"))
    counts = to - from_
    at = np.repeat(from_ - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum()) if len(counts) else from_
    told = members[at], np.repeat(told[1], counts), np.repeat(told[2], counts)
    return tuple(np.concatenate([a, b]) for a, b in zip(whole, told, strict=True))


def _contexts(column: pa.Array, before: int) -> tuple[np.ndarray, np.ndarray]:
    """Words before an anchor (nearest first) and after it, from the bytes of a context."""
    words = np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(len(column), -1) if len(column) else np.zeros((0, 2 * before), np.uint64)
    return words[:, :before], words[:, before:]


def _extended(gram: int, window: int):
    """Batches sorted by seed and key -> the repeats of their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch])
            seed = table["seed"].to_numpy()
            cuts = np.flatnonzero(seed[1:] != seed[:-1])
            at = int(cuts[-1]) + 1 if len(cuts) else 0
            rest = table.slice(at)
            if at:
                yield one(table.slice(0, at))
        if rest is not None and rest.num_rows:
            yield one(rest)

    def one(table: pa.Table) -> pa.RecordBatch:
        left, right = _contexts(table["context"], window - gram)
        row, l, r = extend(table["seed"].to_numpy().view(np.uint64), table["_key"].to_numpy(), left, right, gram, window)  # noqa: E741
        found = table.select(["_key", "members"]).take(pa.array(row)).append_column("l", pa.array(l.astype(np.int32))).append_column("r", pa.array(r.astype(np.int32)))
        return found.combine_chunks().to_batches()[0] if found.num_rows else pa.RecordBatch.from_pylist([], schema=found.schema)

    return run


_MEMBERS = "array<struct<_id:binary,place:int>>"


def _split_hot(places: DataFrame, gram: int, window: int) -> tuple[DataFrame, list[DataFrame]]:
    """(contexts, repeats): anchors with too many places.

    Equal contexts are settled by the smallest key that has them. Anchors of which CHUNK contexts at most are left go on
    as others do; of the rest, each of the windows around a place meets its like by 128 bits of hash, in an aggregate
    that is combined before it is dealt, and again in a join.
    """
    around = window - gram
    places = materialize(places.withColumn("_class", F.md5("context")), "places")
    least = places.groupBy("seed", "_class").agg(F.min("_key").alias("_least"))
    marked = places.join(least, ["seed", "_class"])
    later = marked.where((F.col("_key") > F.col("_least")) & (F.col("before") + gram + F.col("after") >= window))
    whole = later.select("_key", F.array(F.struct("_id", "place")).alias("members"), F.col("before").alias("l"), F.col("after").alias("r"))
    rows = marked.where("_key = _least").groupBy("seed", "_class", "_key").agg(F.collect_list(F.struct("_id", "place")).alias("members"), F.first("context").alias("context"))
    rows = materialize(rows.select("seed", "_key", "members", "context", F.monotonically_increasing_id().alias("_row")), "contexts")
    sizes = rows.groupBy("seed").agg((F.count(F.lit(1)) > CHUNK).alias("_many"))
    rows = rows.join(sizes, "seed")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            left, right = _contexts(batch["context"], around)
            seed, parts = batch["seed"].to_numpy().view(np.uint64), list(_windows(left, right, around))
            row = np.concatenate([p[1] for p in parts])
            l = np.repeat(np.arange(around + 1), [len(p[1]) for p in parts])  # noqa: E741
            one, two = (np.concatenate([p[i] for p in parts]) for i in (2, 3))
            one, two = splitmix(one + seed[row]), splitmix(two + l.astype(np.uint64))
            yield pa.RecordBatch.from_arrays([batch["_row"].take(pa.array(row)), batch["_key"].take(pa.array(row)), pa.array(l.astype(np.int32)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], ["_row", "_key", "l", "one", "two"])

    told = rows.where("_many").select("seed", "_row", "_key", "context").mapInArrow(windows, "_row long, _key long, l int, one long, two long")
    first = told.groupBy("one", "two").agg(F.min("_key").alias("_first"), F.max("_key").alias("_last")).where("_first < _last").select("one", "two", "_first")
    # All windows of a place hold its anchor, so what they cover together has no gap.
    hits = told.join(first, ["one", "two"]).where("_key > _first").groupBy("_row").agg(F.max("l").alias("l"), (F.lit(around) - F.min("l")).alias("r"))
    found = rows.where("_many").select("_row", "_key", "members").join(hits, "_row").select("_key", "members", "l", "r")
    return rows.where("not _many").select("seed", "_key", "members", "context"), [whole, found]


def _beside(docs: DataFrame, known: DataFrame) -> DataFrame:
    """`docs` joined with the rows of `known`, which has some of their keys and ids and lies in files."""
    if known.count() <= FEW_DOCUMENTS:
        wanted = known.select(F.xxhash64("_key", "_id").alias("_hash")).distinct()
        docs = docs.join(F.broadcast(wanted), F.xxhash64("_key", "_id") == F.col("_hash"), "left_semi")
    return docs.join(known.hint("merge"), ["_key", "_id"])


def documents(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """(row, word hashes) of a batch's texts."""
    for block in blocks(batch["_text"]):
        for i, (a, b) in enumerate(pairwise(block.bounds)):
            yield block.first + i, block.hashes[a:b]


def text_id(text: Column) -> Column:
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 32))


def words_joined(text: Column) -> Column:
    """The words of a text, joined by one space."""
    return F.regexp_replace(F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITES)), r"[\x20\x09-\x0D]+", " ")


class Repeats(NamedTuple):
    """spans: key, _id, text, spans [from, to) in words, of documents that repeat something; documents: key, _id, n_words, words_sha256 of all rows."""

    spans: DataFrame
    documents: DataFrame


def find_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = 50, gram: int = 16) -> Repeats:
    """The word spans of every document that another one with a smaller key also has, in runs of `window` words.

    Keys are long; a document with a null key neither loses words nor takes them from others. Rows with the same key
    are one document as to what is smaller. Of equal texts those with larger keys are wholly repeated (if they have a
    window at all) without being compared; their text is null in spans. Null texts have no words. Anchors and what is
    around them are compared by 64-bit hashes of every single word, the anchor itself by two of the run. Places of an
    anchor are gathered in groups of at most CHUNK; of anchors that have more, the places are first told apart along
    the smallest one.
    """
    docs = df.select(df[key].cast("long").alias("_key"), F.coalesce(df[text], F.lit("")).alias("_text"), text_id(df[text]).alias("_id"))
    around = window - gram

    def seeds_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeder = Seeder(window, gram)
        for batch in batches:
            sizes, found, counts = [], [], []
            for _, words in documents(batch):
                seeds, n = np.unique(seeder.seeds(words)[2], return_counts=True)
                sizes.append(len(words))
                found.append(seeds)
                counts.append(n)
            digests = [hashlib.sha256(b" ".join(t.split())).hexdigest() for t in batch["_text"].cast(pa.binary()).to_pylist()]
            columns = [batch["_key"], batch["_id"], pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), lists(found, pa.int64()), lists(counts, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["_key", "_id", "n_words", "words_sha256", "seeds", "counts"])

    def places_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeder = Seeder(window, gram)
        offsets = np.r_[np.arange(-1, -around - 1, -1), np.arange(gram, window)] + around
        edge = np.zeros(window, np.uint64)
        for batch in batches:
            known = batch["shared"]
            rows, seeds, places, contexts, held = [], [], [], [], 0
            for row, words in documents(batch):
                _, at, hashes = seeder.seeds(words)
                own = np.isin(hashes, known[row].values.to_numpy())
                at, hashes, size = at[own], hashes[own], len(words)
                second = seeder.two.runs(seeder.two.prefix(words), gram)[at]
                padded = np.r_[edge[:around], words, edge]
                for i in range(0, len(at), ROWS):
                    part = slice(i, i + ROWS)
                    rows.append(np.full(len(at[part]), row))
                    seeds.append(splitmix(hashes[part].view(np.uint64) + second[part]).view(np.int64))
                    places.append(np.stack([at[part], np.minimum(at[part], around), np.minimum(size - gram - at[part], around)]))
                    contexts.append(padded[at[part][:, None] + offsets])
                    held += len(at[part])
                    if held >= ROWS:
                        yield places_batch(batch, rows, seeds, places, contexts)
                        rows, seeds, places, contexts, held = [], [], [], [], 0
            if held:
                yield places_batch(batch, rows, seeds, places, contexts)

    def places_batch(batch: pa.RecordBatch, rows: list, seeds: list, places: list, contexts: list) -> pa.RecordBatch:
        at, blob = pa.array(np.concatenate(rows)), np.concatenate(contexts).astype("<u8")
        cuts = np.arange(len(blob) + 1, dtype=np.int32) * (16 * around)
        column = pa.Array.from_buffers(pa.binary(), len(blob), [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(blob))])
        columns = [pa.array(np.concatenate(seeds)), batch["_key"].take(at), batch["_id"].take(at), *map(pa.array, np.concatenate(places, axis=1).astype(np.int32)), column]
        return pa.RecordBatch.from_arrays(columns, ["seed", "_key", "_id", "place", "before", "after", "context"])

    seeds = materialize(docs.mapInArrow(seeds_of, "_key long, _id binary, n_words long, words_sha256 string, seeds array<long>, counts array<int>"), "anchors")
    whole = seeds.where(F.col("_key").isNotNull() & (F.col("n_words") >= window))
    first = materialize(whole.groupBy("_id").agg(F.min("_key").alias("_first"), F.max("_key").alias("_last")).where("_first < _last").select("_id", "_first"), "copies")
    copied = whole.select("_key", "_id", "n_words", "seeds", "counts").join(first, "_id", "left").withColumn("_copy", F.coalesce(F.col("_key") > F.col("_first"), F.lit(False)))
    alone = copied.where("not _copy").select("_key", "_id", F.inline(F.arrays_zip("seeds", "counts"))).withColumnRenamed("seeds", "seed")
    shared = alone.groupBy("seed").agg(F.min("_key").alias("a"), F.max("_key").alias("b"), F.sum("counts").alias("n")).where("a < b").select("seed", (F.col("n") > CHUNK).alias("hot"))
    shared = materialize(shared, "shared-anchors")

    def places(anchors: DataFrame) -> DataFrame:
        seeds = anchors.select("seed")
        seeds = F.broadcast(seeds) if anchors.count() <= FEW_ANCHORS else seeds
        known = alone.join(seeds, "seed").groupBy("_key", "_id").agg(F.collect_set("seed").alias("shared"))
        return _beside(docs, materialize(known, "known-documents")).mapInArrow(places_of, _PLACE)

    hot = shared.where("hot")
    rows, found = places(shared.where("not hot")).select("seed", "_key", F.array(F.struct("_id", "place")).alias("members"), "context"), []
    if not hot.isEmpty():
        cool, found = _split_hot(places(hot), gram, window)
        rows = rows.unionByName(cool)
    rows = rows.repartition("seed").sortWithinPartitions("seed", "_key")
    found.append(rows.mapInArrow(_extended(gram, window), f"_key long, members {_MEMBERS}, l int, r int"))
    told = reduce(DataFrame.unionByName, found).select("_key", "l", "r", F.inline("members"))
    parts = F.struct((F.col("place") - F.col("l")).alias("from"), (F.col("place") + gram + F.col("r")).alias("to"))
    merged = told.groupBy("_key", "_id").agg(F.sort_array(F.collect_set(parts)).alias("parts"))
    merged = materialize(merged.select("_key", "_id", merged_spans(F.col("parts")).alias("spans")), "spans")
    texts = _beside(docs.withColumnRenamed("_text", "text"), merged).dropDuplicates(["_key", "_id"])
    gone = copied.where("_copy").dropDuplicates(["_key", "_id"])
    gone = gone.select("_key", "_id", F.lit(None).cast("string").alias("text"), F.array(F.struct(F.lit(0).alias("from"), F.col("n_words").cast("int").alias("to"))).alias("spans"))
    spans = texts.unionByName(gone).select(F.col("_key").alias(key), "_id", "text", "spans")
    return Repeats(spans, seeds.select(F.col("_key").alias(key), "_id", "n_words", "words_sha256"))


def merged_spans(parts: Column) -> Column:
    """Sorted struct(from, to) -> array of the maximal ones that they make together."""
    span = lambda a, b: F.struct(a.alias("from"), b.alias("to"))
    state = lambda done, a, b: F.struct(done.alias("done"), a.alias("from"), b.alias("to"))
    first = parts[0]
    return F.aggregate(
        parts,
        state(F.array().cast("array<struct<from:int,to:int>>"), first["from"], first["to"]),
        lambda s, p: F.when(p["from"] <= s["to"], state(s["done"], s["from"], F.greatest(s["to"], p["to"]))).otherwise(state(F.array_append(s["done"], span(s["from"], s["to"])), p["from"], p["to"])),
        lambda s: F.array_append(s["done"], span(s["from"], s["to"])),
    )


def removed_words(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0), lambda n, s: n + s["to"] - s["from"]).cast("long")


def without_spans(text: Column, spans: Column) -> Column:
    """The words outside the spans, joined by one space (a null text belongs to a wholly repeated document: empty)."""
    words = F.split(words_joined(text), " ")
    starts = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["to"]))
    ends = F.concat(F.transform(spans, lambda s: s["from"]), F.array(F.size(words)))
    parts = F.zip_with(starts, ends, lambda a, b: F.slice(words, a + 1, F.greatest(b - a, F.lit(0))))
    return F.when(text.isNull(), "").otherwise(F.array_join(F.flatten(parts), " "))
