"""Benchmark decontamination: a BM25 index of test items, block-max WAND over every training passage, then overlap."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incidence.llm.bytewords import PUNCTUATION, Block, blocks
from incidence.llm.common import lists, materialize

MATCH = "item_id long, start int, score double, overlap double, question_overlap double, answer_overlap double"
#: Units (by number) of a block, which have one bound per word.
BLOCK = 2
#: Words in a row that count as shared text.
GRAM = 5


def item_units(texts: pa.Array, unit: int = 64) -> Iterator[tuple[int, np.ndarray]]:
    """(row, word hashes) of the units of items: runs of at most `unit` words, the last of which ends with the item."""
    for block in blocks(texts, PUNCTUATION, lower=True):
        for i, (s, e) in enumerate(pairwise(block.bounds)):
            words = block.hashes[s:e]
            for at in [*range(0, max(len(words) - unit, 0), unit), max(len(words) - unit, 0)] if len(words) else ():
                yield block.first + i, words[at : at + unit]


class ItemIndex:
    """Units of test items with BM25 impacts divided by the unit's score for its own words, in blocks by unit number.

    A score of 1 thus means that a passage has all words of a unit, and one threshold serves units of any length. The
    last quarter of a unit's words is taken as its answer and the rest as its question, since items come as one text.
    Counts of units per word, the number of units and their mean length are those of all items, of which this index may
    hold a part. Units of fewer than GRAM words are apart: they match only texts that say nothing else.
    """

    def __init__(self, units: list[tuple[int, np.ndarray]], threshold: float, counts: dict[int, int], n: int, mean: float, unit: int = 64, k1: float = 1.2, b: float = 0.75):
        self.threshold, self.unit = threshold, unit
        self.short: dict[tuple, list[int]] = {}
        for owner, words in units:
            if len(words) < GRAM:
                self.short.setdefault(tuple(words.tolist()), []).append(owner)
        units = [u for u in units if len(u[1]) >= GRAM]
        self.owners = [owner for owner, _ in units]
        parts = [words for _, words in units]
        self.vocabulary = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
        self.units = [np.searchsorted(self.vocabulary, p).astype(np.int32) for p in parts]
        self.near = np.zeros(1 << 16, bool)  # low bits of the vocabulary, to pass over other words fast
        self.near[(self.vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True
        df = np.array([counts[w] for w in self.vocabulary.tolist()], np.float64)
        self._score(np.log1p((n - df + 0.5) / (df + 0.5)), mean, k1, b)

    def _score(self, idf: np.ndarray, mean: float, k1: float, b: float) -> None:
        size, n = len(self.vocabulary), len(self.units)
        terms, owners, impacts = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0)]
        for u, words in enumerate(self.units):
            t, tf = np.unique(words, return_counts=True)
            impact = idf[t] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(words) / mean))
            terms.append(t)
            owners.append(np.full(len(t), u, np.int32))
            impacts.append(impact / impact.sum())
        terms, owners, impacts = np.concatenate(terms), np.concatenate(owners), np.concatenate(impacts)
        order = np.argsort(terms, kind="stable")  # units ascend within a term
        terms, self.flat_units, self.flat_impacts = terms[order], owners[order], impacts[order]
        self.starts = np.searchsorted(terms, np.arange(size + 1))
        self.bound = np.maximum.reduceat(self.flat_impacts, self.starts[:-1]) if size else np.zeros(0)
        # A word's largest impact in each block that has it.
        cell = terms.astype(np.int64) * (n // BLOCK + 1) + self.flat_units // BLOCK
        heads = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, np.int64)
        self.block_of, self.block_bound = self.flat_units[heads] // BLOCK, np.maximum.reduceat(self.flat_impacts, heads) if len(heads) else np.zeros(0)
        self.block_starts = np.searchsorted(terms[heads], np.arange(size + 1))
        # Frequent words give a unit u at most spare[u] together, less than the threshold: the rest must come from others.
        spare, frequent = np.zeros(n), np.zeros(size, bool)
        for t in np.argsort(-np.diff(self.starts), kind="stable"):
            units, own = self.posting(t)
            if (spare[units] + own).max() > self.threshold / 2:
                break
            spare[units] += own
            frequent[t] = True
        self.telling = ~frequent
        self.spare = np.maximum.reduceat(spare, np.arange(0, n, BLOCK)) if n else spare

    def posting(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        """Units and impacts of a word."""
        s = slice(self.starts[term], self.starts[term + 1])
        return self.flat_units[s], self.flat_impacts[s]

    def live_blocks(self, passage: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(passage, block), sorted: the blocks whose bounds for a passage's words reach the threshold, from pairs (passage, telling word).

        The bounds are a word's largest impact in the block, and for all frequent words together the block's spare.
        """
        size, n = len(self.vocabulary), len(self.spare)
        pairs = np.unique(passage * size + term)
        passage, term = pairs // size, pairs % size
        lengths = self.block_starts[term + 1] - self.block_starts[term]
        at = np.repeat(self.block_starts[term] - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(lengths.sum())
        cell = np.repeat(passage, lengths) * n + self.block_of[at]
        order = np.argsort(cell, kind="stable")
        cell, heads = np.unique(cell[order], return_index=True)
        if not len(cell):
            return cell, cell
        cell = cell[np.add.reduceat(self.block_bound[at][order], heads) >= self.threshold - self.spare[cell % n] - 1e-6]
        return cell // n, cell % n

    def search(self, terms: list[int], live: list[int]) -> list[tuple[int, float]]:
        """All (unit, score) with a score of the threshold at least, by block-max WAND; `live` are the blocks that can have some."""
        least, found = self.threshold - 1e-9, []
        cursors = []  # unit, place, word, units, impacts
        for t in terms:
            units, impacts = self.posting(t)
            cursors.append([0, 0, t, units, impacts])
        cursors = self._move(cursors, len(cursors) - 1, live[0] * BLOCK) if live else []
        for c in cursors:
            c[0] = int(c[3][c[1]])
        while cursors:
            cursors.sort(key=lambda c: c[0])
            total, pivot = 0.0, -1
            for i, c in enumerate(cursors):
                total += self.bound[c[2]]
                if total >= least:
                    pivot = i
                    break
            if pivot < 0:
                break
            unit = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == unit:
                pivot += 1
            place = bisect_left(live, unit // BLOCK)
            if place == len(live):
                break
            if live[place] != unit // BLOCK:  # no unit will do before the next live block
                cursors = self._move(cursors, pivot, live[place] * BLOCK)
            elif cursors[0][0] == unit:
                score = float(sum(c[4][c[1]] for c in cursors[: pivot + 1]))
                if score >= least:
                    found.append((unit, score))
                cursors = self._move(cursors, pivot, unit + 1)
            else:
                cursors = self._move(cursors, pivot, unit)
        return found

    def _move(self, cursors: list, pivot: int, unit: int) -> list:
        """The first cursors moved to `unit` or beyond; those at their end go."""
        out = cursors[pivot + 1 :]
        for c in cursors[: pivot + 1]:
            if c[0] < unit:
                c[1] = int(np.searchsorted(c[3], unit))
                if c[1] == len(c[3]):
                    continue
                c[0] = int(c[3][c[1]])
            out.append(c)
        return out

    def overlaps(self, unit: int, passage: set, of) -> tuple[float, float, float]:
        """Shares of the unit's, its question's and its answer's runs of words that the passage has."""
        words = self.units[unit].tolist()
        runs = of(words)
        tail = max(1, min(len(words) // 4, len(runs) - 1))
        share = lambda part: sum(g in passage for g in part) / len(part) if part else 1.0
        return share(runs), share(runs[:-tail]), share(runs[-tail:])


def _grams(words: list[int]) -> list[tuple]:
    n = min(GRAM, len(words))
    return list(zip(*(words[i:] for i in range(n)), strict=False)) if n else []


def _passages(bounds: np.ndarray, unit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, from, to): runs of 2 * unit words at every unit-th word, so that any `unit` words in a row lie in one."""
    sizes = np.diff(bounds)
    counts = np.maximum(1, -(-(sizes - unit) // unit))
    text = np.repeat(np.arange(len(sizes)), counts)
    k = np.arange(len(text)) - np.repeat(np.r_[0, np.cumsum(counts)[:-1]], counts)
    start = bounds[text] + k * unit
    return text, start, np.minimum(start + 2 * unit, bounds[text + 1])


def find_matches(index: ItemIndex, block: Block, min_overlap: float, min_part: float) -> Iterator[tuple[int, dict]]:
    """(text, {item: match}) of a block's texts that overlap an item."""
    found: dict[int, dict] = {}
    if index.short:
        for t in np.flatnonzero((np.diff(block.bounds) > 0) & (np.diff(block.bounds) < GRAM)):
            words = tuple(block.hashes[block.bounds[t] : block.bounds[t + 1]].tolist())
            for item in index.short.get(words, ()):
                found.setdefault(int(t), {})[item] = {"item_id": item, "start": 0, "score": 1.0, "overlap": 1.0, "question_overlap": 1.0, "answer_overlap": 1.0}
    if len(index.vocabulary) and len(block.hashes):
        _search(index, block, min_overlap, min_part, found)
    for t, items in sorted(found.items()):
        yield block.first + t, items


def _search(index: ItemIndex, block: Block, min_overlap: float, min_part: float, found: dict[int, dict]) -> None:
    """Adds to `found` the matches of all passages of a block's texts."""
    ids = np.full(len(block.hashes), -1)
    maybe = np.flatnonzero(index.near[(block.hashes & np.uint64(0xFFFF)).astype(np.int64)])
    at = np.minimum(np.searchsorted(index.vocabulary, block.hashes[maybe]), len(index.vocabulary) - 1)
    hit = index.vocabulary[at] == block.hashes[maybe]
    ids[maybe[hit]] = at[hit]
    text, start, end = _passages(block.bounds, index.unit)
    telling = np.flatnonzero((ids >= 0) & index.telling[ids])
    last = np.searchsorted(start, telling, side="right") - 1  # a word lies in the last passage that starts before it, and maybe in the one before
    earlier = np.maximum(last - 1, 0)
    twice = (last > 0) & (telling < end[earlier])
    passages, live = index.live_blocks(np.r_[last, earlier[twice]], np.r_[ids[telling], ids[telling[twice]]])
    heads = np.flatnonzero(np.r_[True, passages[1:] != passages[:-1]]) if len(passages) else passages
    for p, own_live in zip(passages[heads], np.split(live, heads[1:]), strict=True) if len(heads) else ():
        own = ids[start[p] : end[p]]
        terms = np.unique(own[own >= 0])
        runs = None
        for unit, score in index.search(terms.tolist(), own_live.tolist()):
            runs = set(_grams(own.tolist())) if runs is None else runs
            whole, question, answer = index.overlaps(unit, runs, _grams)
            if whole < min_overlap or min(question, answer) < min_part:
                continue
            t, item = int(text[p]), index.owners[unit]
            match = {"item_id": item, "start": int(start[p] - block.bounds[t]), "score": score, "overlap": whole, "question_overlap": question, "answer_overlap": answer}
            best = found.setdefault(t, {}).get(item)
            if best is None or (match["overlap"], match["score"]) > (best["overlap"], best["score"]):
                found[t][item] = match


def _indexes(items: DataFrame, item_key: str, item_text: str, threshold: float, max_bytes: int) -> Iterator:
    """Broadcast indexes of the items, one at a time: of all units, or, beyond `max_bytes` of words, of parts of that size.

    Word counts, the number of units and their mean length come from one aggregate over all items, whatever the parts.
    """

    def units_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(item_units(batch["text"]))
            rows = pa.array([row for row, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch["id"].take(rows), lists([w.view(np.int64) for _, w in found], pa.int64())], ["id", "words"])

    rows = items.select(items[item_key].cast("long").alias("id"), F.coalesce(items[item_text], F.lit("")).alias("text")).where("id is not null")
    units = materialize(rows.mapInArrow(units_of, "id long, words array<long>").distinct(), "item-units")
    whole = units.where(F.size("words") >= GRAM)
    n, mean, words = whole.agg(F.count(F.lit(1)), F.avg(F.size("words")), F.coalesce(F.sum(F.size("words")), F.lit(0))).first()
    counts = materialize(whole.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").count(), "item-words")
    parts = max(1, -(-8 * words // max_bytes))
    for k in range(parts):
        part = units.where(F.pmod(F.xxhash64("id", "words"), F.lit(parts)) == k)
        own = counts.join(part.select(F.explode("words").alias("word")).distinct(), "word", "left_semi").toArrow()
        held = dict(zip(own["word"].to_numpy().view(np.uint64).tolist(), own["count"].to_pylist(), strict=True))
        table = part.orderBy("id", "words").toArrow()
        sizes = np.r_[0, np.cumsum(pc.list_value_length(table["words"]).to_numpy())].astype(np.int64)
        flat = table["words"].combine_chunks().flatten().to_numpy().view(np.uint64) if table.num_rows else np.zeros(0, np.uint64)
        index = ItemIndex([(i, flat[a:b]) for i, (a, b) in zip(table["id"].to_pylist(), pairwise(sizes), strict=True)], threshold, held, n, mean or 1.0)
        yield parts, items.sparkSession.sparkContext.broadcast(index)


def contamination(
    df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", threshold: float = 0.5, min_overlap: float = 0.8, min_part: float = 0.5, max_bytes: int = 64 << 20
) -> DataFrame:
    """key and the fields of MATCH: one row per row of `df` and test item that it holds; clean rows have none.

    Words are runs of letters and digits, A-Z lower-cased. Every passage of every whole text is looked up: all units
    whose BM25 score is `threshold` of their own at least are checked for runs of five words, of which the passage must
    have `min_overlap` of all and `min_part` of those of the question and of the answer. Items of fewer than five words
    are found only where a text consists of nothing else, as such runs are in many clean texts. Null and empty items
    are not looked for. Null texts hold nothing. An index has at most about `max_bytes` of word hashes; more items are
    searched for in several such blocks, one after the other, with the same scores.
    """
    rows = df.select(df[key].alias("_key"), F.coalesce(df[text], F.lit("")).alias("_text"))
    found = None
    for parts, index in _indexes(items, item_key, item_text, threshold, max_bytes):

        def search(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, out = [], []
                for block in blocks(batch["_text"], PUNCTUATION, lower=True):
                    for row, matches in find_matches(index.value, block, min_overlap, min_part):
                        at += [row] * len(matches)
                        out += [matches[i] for i in sorted(matches)]
                keys = batch["_key"].take(pa.array(at, pa.int64()))
                fields = {"item_id": pa.int64(), "start": pa.int32(), "score": pa.float64(), "overlap": pa.float64(), "question_overlap": pa.float64(), "answer_overlap": pa.float64()}
                yield pa.RecordBatch.from_arrays([keys, *(pa.array([m[f] for m in out], kind) for f, kind in fields.items())], ["_key", *fields])

        part = rows.mapInArrow(search, f"_key {dict(rows.dtypes)['_key']}, {MATCH}")
        if parts > 1:
            part = materialize(part, "item-matches")
            index.unpersist()
        found = part if found is None else found.unionByName(part)
    if parts > 1:  # units of one item may lie in different parts
        best = F.max_by(F.struct(*[f for f in found.columns if f != "_key"]), F.struct("overlap", "score"))
        found = found.withColumn("_item", F.col("item_id")).groupBy("_key", "_item").agg(best.alias("_best")).select("_key", "_best.*")
    return found.withColumnRenamed("_key", key)


def without_contaminated(
    df: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", threshold: float = 0.5, min_overlap: float = 0.8, min_part: float = 0.5, max_bytes: int = 64 << 20
) -> DataFrame:
    """The rows of `df`, all columns, that hold no test item, as `contamination` finds them; without any shuffle."""
    for parts, index in _indexes(items, item_key, item_text, threshold, max_bytes):

        def clean(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for block in blocks(batch[text].fill_null(""), PUNCTUATION, lower=True):
                    for row, _ in find_matches(index.value, block, min_overlap, min_part):
                        keep[row] = False
                yield batch.filter(pa.array(keep))

        df = df.mapInArrow(clean, df.schema)
        if parts > 1:
            df = materialize(df, "clean")
            index.unpersist()
    return df
