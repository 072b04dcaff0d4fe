"""Line dedup: an exact set-similarity join of lines by prefix, positional, length and bitmap filters."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incidence.llm.bytewords import Block, blocks
from incidence.llm.common import lists, materialize, splitmix, unused

#: Buckets of the word count sketch, which the driver and every task hold as one byte each.
BUCKETS = 1 << 22
#: Buckets in a row of the sketch table.
SLICE = 1 << 16
#: Steps of the logarithmic rarity classes per doubling.
STEPS = 8
#: Lines per word beyond which a word's postings are dealt out as pairs of chunks.
CHUNK = 1 << 16
#: Lines of a group beyond which it is dealt out as pairs of chunks in the second round, where all are compared.
SPLIT = 4096
#: Sets that a task remembers to have told.
REMEMBERED = 1 << 19
#: Earliest candidates of a line that a group names at first, where one of them is close for sure, and where none is.
#: Lines that none of them settles get all their candidates in a second round.
NAMED, NAMED_WEAK = 4, 16
#: Words of a line up to which the bitmap tells nearly all differences.
EXACT_BITS = 40
_HASH_BITS, _PLACE_BITS = 40, 28
#: Documents that are told to every task (a megabyte of keys) to read only their lines again; beyond, a bit table tells which lines are wanted.
FEW_DOCUMENTS = 1 << 17
#: Bits of the table that tells which lines are wanted again, and the most of them for which it is used.
WANTED_BITS, WANTED_MOST = 1 << 26, 1 << 23
_BUCKET_MASK = np.uint64(BUCKETS - 1)


class Threshold(NamedTuple):
    """Jaccard similarity of num / den at least, in whole numbers."""

    num: int = 4
    den: int = 5

    def prefix(self, size):
        """Rarest words of which a similar line must share one."""
        return size - -(-self.num * size // self.den) + 1

    def joins(self, size):
        """Whether lines of `size` words can be similar to one with other words: it has a word more or less then."""
        return size * (self.den - self.num) >= self.num

    def shared(self, total):
        """Words that lines of `total` words together must share."""
        return -(-self.num * total // (self.num + self.den))


class LineTokens(NamedTuple):
    """Distinct words of a block's lines, rarest first: row and number of each line, and line, id and place of each word.

    sids and checks are two independent hashes of a line's set of words; starts is where its words start in the block.
    """

    rows: np.ndarray
    numbers: np.ndarray
    sizes: np.ndarray
    sids: np.ndarray
    checks: np.ndarray
    starts: np.ndarray
    line: np.ndarray
    ids: np.ndarray
    place: np.ndarray


def line_tokens(block: Block, classes: np.ndarray) -> LineTokens:
    """Lines with words of a block. A word's id is its rarity class and 40 bits of its hash; sid stands for a line's set."""
    row = np.repeat(np.arange(len(block.bounds) - 1), np.diff(block.bounds))
    before = np.r_[0, np.cumsum(block.lines + 1)]
    line = before[row] + block.line  # ascending, as words come in order
    fresh = np.r_[True, line[1:] != line[:-1]] if len(line) else np.zeros(0, bool)
    names, line, starts = line[fresh], np.cumsum(fresh) - 1, np.flatnonzero(fresh)
    # The least and the greatest of the words' second hashes: no matter how often a word comes.
    second = splitmix(block.hashes + np.uint64(0xA0761D6478BD642F))
    checks = splitmix(np.minimum.reduceat(second, starts) ^ splitmix(np.maximum.reduceat(second, starts))) if len(starts) else second
    ids = (classes[block.hashes & _BUCKET_MASK].astype(np.uint64) << np.uint64(_HASH_BITS)) | (block.hashes >> np.uint64(64 - _HASH_BITS))
    if len(names) <= 1 << 16:
        key = np.sort((line.astype(np.uint64) << np.uint64(48)) | ids)
        key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
        line, ids = (key >> np.uint64(48)).astype(np.int64), key & np.uint64((1 << 48) - 1)
    else:
        order = np.lexsort((ids, line))
        line, ids = line[order], ids[order]
        new = np.r_[True, (line[1:] != line[:-1]) | (ids[1:] != ids[:-1])]
        line, ids = line[new], ids[new]
    sizes = np.bincount(line, minlength=len(names))
    heads = np.r_[0, np.cumsum(sizes)]
    sids = np.add.reduceat(splitmix(ids * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)), heads[:-1]) if len(names) else np.zeros(0, np.uint64)
    owner = np.searchsorted(before, names, side="right") - 1
    return LineTokens(owner + block.first, names - before[owner], sizes, splitmix(sids).view(np.int64), checks.view(np.int64), starts, line, ids, np.arange(len(line)) - heads[line])


def _sketch(docs: DataFrame) -> np.ndarray:
    """Rarity class per bucket of word hashes, from the words of all texts: 8 * log2(count), one byte each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int32)
        held: list[np.ndarray] = []
        for batch in batches:
            for block in blocks(batch["_text"]):
                held.append((block.hashes & _BUCKET_MASK).astype(np.int32))
                if sum(map(len, held)) > 1 << 20:
                    counts += np.bincount(np.concatenate(held), minlength=BUCKETS).astype(np.int32)
                    held.clear()
        if held:
            counts += np.bincount(np.concatenate(held), minlength=BUCKETS).astype(np.int32)
        used = [i for i in range(0, BUCKETS, SLICE) if counts[i : i + SLICE].any()]
        packed = [np.minimum(counts[i : i + SLICE], 65535).astype("<u2").tobytes() for i in used]
        yield pa.RecordBatch.from_arrays([pa.array([i // SLICE for i in used], pa.int32()), pa.array(packed, pa.binary())], ["slice", "part"])

    def total(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLICE, np.int64)
        for batch in batches:
            for x in batch["part"].to_pylist():
                counts += np.frombuffer(x, "<u2")
        classes = np.minimum(255, np.round(STEPS * np.log2(np.maximum(counts, 1)))).astype(np.uint8)
        yield _slice(key, classes)

    return _table(docs.select("_text").mapInArrow(count, "slice int, part binary").groupBy("slice").applyInArrow(total, "slice int, part binary"), BUCKETS, SLICE)


def _slice(key: tuple, values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([values.tobytes()], pa.binary())], ["slice", "part"])


def _table(slices: DataFrame, size: int, step: int) -> np.ndarray:
    """A byte table of fixed size on the driver, from its slices."""
    table = np.zeros(size, np.uint8)
    for r in slices.collect():
        table[r["slice"] * step : (r["slice"] + 1) * step] = np.frombuffer(r["part"], np.uint8)
    return table


def _wanted_bits(sids: DataFrame) -> np.ndarray:
    """A bit table (WANTED_BITS) in which every sid has its bit set; others may by chance."""
    step = WANTED_BITS // 256

    def mark(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(step, bool)
        for batch in batches:
            bits[batch["sid"].to_numpy() & (step - 1)] = True
        yield _slice(key, np.packbits(bits, bitorder="little"))

    keyed = sids.select("sid", F.shiftright("sid", (step - 1).bit_length()).bitwiseAND(255).cast("int").alias("slice"))
    return _table(keyed.groupBy("slice").applyInArrow(mark, "slice int, part binary"), WANTED_BITS // 8, step // 8)


def _pairs(limit: Threshold, named: int | None):
    """Batches sorted by group -> for each line its earlier candidates in the group (the first `named`) and if there are more."""

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            key = table["group"].to_numpy()
            cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
            at = int(cuts[-1]) if len(cuts) else 0
            rest = table.slice(at)
            if at:
                yield search(table.slice(0, at))
        if rest is not None and rest.num_rows:
            yield search(rest)

    def search(table: pa.Table) -> pa.RecordBatch:
        get = {c: table[c].to_numpy() for c in table.column_names}
        group = np.cumsum(np.r_[0, get["group"][1:] != get["group"][:-1]])
        rows = np.flatnonzero(np.bincount(group)[group] > 1)
        rows = rows[np.lexsort((get["number"][rows], get["doc"][rows], group[rows]))]
        _, first = np.unique(splitmix(group[rows].astype(np.uint64)) ^ get["sid"][rows].view(np.uint64), return_index=True)
        keep = rows[np.sort(first)]  # the earliest row of a set in a group
        keep = keep[np.bincount(group[keep], minlength=group[-1] + 1)[group[keep]] > 1]
        get, group = {c: v[keep] for c, v in get.items()}, group[keep]
        size, mark, bits = get["meta"] >> 32, get["meta"] & 0xFFFFFFFF, np.stack([get["bits"], get["more_bits"]], axis=1).view(np.uint64)
        first_side, inner, after = mark >> 1 & 1, mark & 1 == 1, size - (mark >> 2)  # words from the one in common on
        shared = limit.shared(np.arange(2 * int(size.max(initial=0)) + 1))
        # The smaller line of a pair must have the common word early; groups without such a line have no pair.
        early = np.bincount(group, weights=after >= shared[2 * size], minlength=1) > 0
        met, close = np.zeros(len(group), np.int64), np.zeros(len(group), bool)
        most = lambda x: np.where(close[x], named, max(named, NAMED_WEAK))
        xs, ys = [], []
        starts = np.searchsorted(group, group, side="left")
        rows = np.arange(len(group))
        alive = rows[early[group] & (rows > starts) & (get["open"] if "open" in get else True)]
        step = 0
        while len(alive):  # each line against the step-th earliest of its group
            y = starts[alive] + step
            total = size[alive] + size[y]
            near = np.flatnonzero(np.minimum(after[alive], after[y]) >= shared[total])
            if len(near):
                x, y, apart = alive[near], y[near], total[near] - 2 * shared[total[near]]
                differ = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1)
                ok = differ <= apart
                ok &= (first_side[x] != first_side[y]) | inner[x]
                ok &= (get["doc"][x] != get["doc"][y]) | (get["number"][x] != get["number"][y])
                if named is not None:
                    met[x[ok]] += 1
                    ok &= met[x] <= most(x)
                    close[x[ok & ((2 * differ <= apart) | (size[x] <= EXACT_BITS))]] = True
                xs.append(x[ok])
                ys.append(y[ok])
            step += 1
            alive = alive[(starts[alive] + step < alive) & ((met[alive] <= most(alive)) if named is not None else True)]
        x, y = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (xs, ys))
        more = met[x] > most(x) if named is not None else np.zeros(len(x), bool)
        columns = [get["sid"][x], get["doc"][x], get["sid"][y], get["doc"][y], more]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["x", "x_doc", "y", "y_doc", "more"])

    return candidates


def _deal(ids: np.ndarray, place: np.ndarray, sids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(copies of each posting, groups, marks): a word's lines are a group, or, if there may be many, pairs of chunks of them.

    A mark is place, whether the line is in the first chunk of the pair, and whether both chunks are the same.
    """
    chunks = np.maximum(1, np.ceil(2.0 ** ((ids >> np.uint64(_HASH_BITS)) / STEPS) / CHUNK)).astype(np.int64)
    own = (sids.view(np.uint64) % chunks.astype(np.uint64)).astype(np.int64)
    other = np.arange(chunks.sum()) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    own, ids, place = np.repeat(own, chunks), np.repeat(ids, chunks), np.repeat(place, chunks)
    low, high = np.minimum(own, other), np.maximum(own, other)
    groups = splitmix(ids ^ splitmix((low.astype(np.uint64) << np.uint64(32)) | high.astype(np.uint64)))
    place = np.minimum(place, (1 << _PLACE_BITS) - 1)  # a lower place only rules out less
    return chunks, groups.view(np.int64), (place << 2 | (own == low).astype(np.int64) << 1 | (low == high)).astype(np.int32)


def _postings(lines: DataFrame) -> DataFrame:
    """A row per line and group that it is dealt to."""
    rows = lines.where("groups is not null").select("sid", F.col("_key").alias("doc"), "number", "size", "bits", "more_bits", F.inline(F.arrays_zip("groups", "marks")))
    return rows.select(F.col("groups").alias("group"), "doc", "number", "sid", "bits", "more_bits", (F.shiftleft(F.col("size").cast("long"), 32) + F.col("marks")).alias("meta"))


def _dealt(postings: DataFrame) -> DataFrame:
    """Groups of more than SPLIT lines as pairs of chunks of them; marks change as in `_deal`."""
    sizes = materialize(postings.groupBy("group").count().where(F.col("count") > SPLIT), "dense-groups")
    rows = postings.join(sizes, "group", "left").withColumn("_g", F.ceil(F.coalesce("count", F.lit(1)) / SPLIT).cast("int"))
    rows = rows.withColumn("_own", F.pmod(F.xxhash64("sid"), F.col("_g")).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_g") - 1)))
    low, high = F.least("_own", "_other"), F.greatest("_own", "_other")
    marks = F.when(F.col("_own") == low, 2).otherwise(0) + F.when(low == high, 1).otherwise(0)
    whole = (F.col("_g") > 1) & (F.col("meta").bitwiseAND(1) == 1)  # those with sides keep them
    meta = F.when(whole, F.col("meta").bitwiseAND(~3) + marks).otherwise(F.col("meta"))
    group = F.when(F.col("_g") > 1, F.xxhash64("group", low, high)).otherwise(F.col("group"))
    return rows.select(group.alias("group"), "doc", "number", "sid", "bits", "more_bits", meta.alias("meta"), "open")


def _candidates(postings: DataFrame, limit: Threshold, named: int | None) -> DataFrame:
    rows = postings.repartition("group").sortWithinPartitions("group")
    return rows.mapInArrow(_pairs(limit, named), "x long, x_doc long, y long, y_doc long, more boolean")


def _verified(pairs: DataFrame, docs: DataFrame, classes, limit: Threshold) -> DataFrame:
    """sid and check of the lines x of the pairs that have the similarity, by their whole word sets, read again from the texts.

    The sets are of 64-bit hashes of the words.
    """
    ends = F.array(F.struct(F.col("x_doc").alias("_key"), F.col("x").alias("sid")), F.struct(F.col("y_doc").alias("_key"), F.col("y").alias("sid")))
    wanted = materialize(pairs.select(F.inline(ends)).distinct(), "wanted-lines")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            sids, checks, words = [], [], []
            for block in blocks(batch["_text"], with_lines=True):
                found = line_tokens(block, classes.value)
                starts = np.r_[found.starts, len(block.hashes)]
                place = found.sids & (WANTED_BITS - 1)
                hit = bits.value[place >> 3] >> (place & 7) & 1 if bits else np.ones(len(place))
                for i in np.flatnonzero(hit):
                    sid = int(found.sids[i])
                    if sid in seen:
                        continue
                    seen.add(sid)
                    sids.append(sid)
                    checks.append(int(found.checks[i]))
                    words.append(np.unique(block.hashes[starts[i] : starts[i + 1]]).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(sids, pa.int64()), pa.array(checks, pa.int64()), lists(words, pa.int64())], ["sid", "check", "words"])

    # A line of the set may be read from any document that has it: from the few documents wanted, or else from all,
    # where a bit table of the sids tells most lines apart if it is sparse enough.
    bits, documents = None, materialize(wanted.select("_key").distinct(), "wanted-documents")
    few = documents.count() <= FEW_DOCUMENTS
    if not few and wanted.count() <= WANTED_MOST:
        bits = docs.sparkSession.sparkContext.broadcast(_wanted_bits(wanted.select("sid")))
        texts = docs.select("_text")
    else:
        texts = docs.join(F.broadcast(documents) if few else documents, "_key", "left_semi").select("_text")
    words = texts.mapInArrow(sets, "sid long, check long, words array<long>").join(wanted.select("sid").distinct().hint("merge"), "sid", "left_semi").dropDuplicates(["sid"])
    both = pairs.select("x", "y").join(words.select(F.col("sid").alias("x"), "check", F.col("words").alias("a")), "x").join(words.select(F.col("sid").alias("y"), F.col("words").alias("b")), "y")
    shared = F.size(F.array_intersect("a", "b"))
    return both.where(shared * (limit.num + limit.den) >= (F.size("a") + F.size("b")) * limit.num).select(F.col("x").alias("sid"), "check").distinct()


def repeated_lines(df: DataFrame, key: str = "doc_id", text: str = "text", similarity: tuple[int, int] = (4, 5), min_words: int = 5) -> DataFrame:
    """key, _id, removed: the documents with lines to remove, and the numbers (from 0) of these lines.

    A line is removed if an earlier one (by key, then number), in its own document or another, has a word set with a
    Jaccard similarity of `similarity` (numerator, denominator) at least; removed lines count as earlier ones too.
    Lines are parted by newlines, words by white space; lines with fewer than `min_words` different words stay and
    count for nothing, as do those of documents with a null key. Rows with equal keys are one document: lines with the
    same number don't remove each other. Null and empty texts have no lines with words.

    Word frequencies come from a sketch of all texts, which orders words from rare to frequent in a table of fixed
    size. Equal sets count once; they are told by two hashes of 64 bits. Lines meet in groups of equal prefix words, where length, position and a bitmap of the
    words rule out most; of what is left the earliest NAMED per group (NAMED_WEAK, if the bitmaps leave it open whether
    one of them is similar) are verified on whole sets, and lines that none of them settles are compared with all
    their candidates in a second round, so that dense groups stay linear.
    """
    limit = Threshold(*similarity)
    docs = df.select(df[key].cast("long").alias("_key"), F.coalesce(df[text], F.lit("")).alias("_text")).where("_key is not null")
    spark = df.sparkSession
    classes = spark.sparkContext.broadcast(_sketch(docs))

    def tokens_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[int, int]] = {}  # a set's postings go out once per task, or again for an earlier line
        for batch in batches:
            keys = batch["_key"].to_numpy()
            for block in blocks(batch["_text"], with_lines=True):
                found = line_tokens(block, classes.value)
                if not len(found.sizes):
                    continue
                long = found.sizes >= min_words
                heads = np.r_[0, np.cumsum(found.sizes)[:-1]]
                flags, high = np.uint64(1) << (found.ids & np.uint64(63)), (found.ids & np.uint64(64)) > 0
                bits, more_bits = (np.bitwise_xor.reduceat(np.where(high == h, flags, np.uint64(0)), heads).view(np.int64) for h in (False, True))
                docs_, fresh = keys[found.rows], np.zeros(len(long), bool)
                names = zip(docs_.tolist(), found.numbers.tolist(), found.sids.tolist(), long.tolist(), strict=True)
                for i, (doc, number, sid, counts) in enumerate(names):
                    if counts and ((known := best.get(sid)) is None or (doc, number) < known):
                        best[sid], fresh[i] = (doc, number), True
                if len(best) > REMEMBERED:
                    best.clear()
                alone = found.ids >> np.uint64(_HASH_BITS) == 0  # a word of one line only meets no other
                chosen = fresh[found.line] & (found.place < limit.prefix(found.sizes)[found.line]) & limit.joins(found.sizes)[found.line] & ~alone
                copies, groups, marks = _deal(found.ids[chosen], found.place[chosen], found.sids[found.line[chosen]])
                sizes = np.bincount(np.repeat(found.line[chosen], copies), minlength=len(long))
                offsets = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
                columns = {"_key": docs_, "number": found.numbers.astype(np.int32), "sid": found.sids, "check": found.checks, "size": found.sizes.astype(np.int32), "bits": bits, "more_bits": more_bits}
                columns |= {"groups": pa.ListArray.from_arrays(offsets, pa.array(groups)), "marks": pa.ListArray.from_arrays(offsets, pa.array(marks))}
                table = pa.table(columns | {"_id": batch["_id"].take(pa.array(found.rows))}).filter(pa.array(long))
                yield from table.select(["_key", "_id", "number", "sid", "check", "size", "bits", "more_bits", "groups", "marks"]).to_batches()

    with_ids = docs.withColumn("_id", F.xxhash64("_text"))
    lines = materialize(with_ids.mapInArrow(tokens_of, "_key long, _id long, number int, sid long, check long, size int, bits long, more_bits long, groups array<long>, marks array<int>"), "lines")
    postings = _postings(lines)
    named = materialize(_candidates(postings, limit, NAMED).groupBy("x", "y").agg(F.min("x_doc").alias("x_doc"), F.min("y_doc").alias("y_doc"), F.max("more").alias("more")), "line-pairs")
    similar = materialize(_verified(named, docs, classes, limit), "similar-lines")
    unsettled = named.where("more").select(F.col("x").alias("sid")).distinct().join(similar.select("sid"), "sid", "left_anti")
    unsettled = materialize(unsettled, "open-lines")
    if not unsettled.isEmpty():
        groups = materialize(_postings(lines.join(unsettled, "sid")).select("group").distinct(), "open-groups")
        marked = postings.join(groups, "group", "left_semi").join(unsettled.withColumn("open", F.lit(True)), "sid", "left").withColumn("open", F.coalesce("open", F.lit(False)))
        rest = _candidates(_dealt(marked), limit, None).groupBy("x", "y").agg(F.min("x_doc").alias("x_doc"), F.min("y_doc").alias("y_doc"))
        similar = similar.unionByName(_verified(materialize(rest, "line-pairs"), docs, classes, limit)).distinct()
    order = F.struct("_key", "number")
    first = lines.groupBy("sid", "check").agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("_n"))
    first = materialize(first.join(similar.withColumn("_similar", F.lit(True)), ["sid", "check"], "left").where("_n > 1 or _similar").drop("_n"), "line-sets")
    gone = lines.select("_key", "_id", "number", "sid", "check").join(first.hint("merge"), ["sid", "check"]).where((order > F.col("_first")) | F.col("_similar").isNotNull())
    return gone.groupBy(F.col("_key").alias(key), "_id").agg(F.sort_array(F.collect_set("number")).alias("removed"))


def without_lines(text: Column, removed: Column) -> Column:
    """The text without the lines of these numbers."""
    kept = F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains(removed, i))
    return F.when(removed.isNull(), text).otherwise(F.array_join(kept, "\n"))


def dedup_lines(df: DataFrame, key: str = "doc_id", text: str = "text", similarity: tuple[int, int] = (4, 5), min_words: int = 5) -> DataFrame:
    """The rows and columns of `df`, with `text` freed of repeated lines (see `repeated_lines`). Null texts stay null."""
    names = unused(df, "_gone_key", "_gone_id", "_gone")
    gone = repeated_lines(df, key, text, similarity, min_words).toDF(*names)
    hashed = F.xxhash64(F.coalesce(df[text], F.lit("")))
    joined = df.join(gone.hint("merge"), (df[key].cast("long") == gone[names[0]]) & (hashed == gone[names[1]]), "left")
    return joined.select(*[without_lines(df[c], gone[names[2]]).alias(c) if c == text else df[c] for c in df.columns])
