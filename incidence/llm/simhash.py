"""SimHash near-duplicates: pigeonhole blocks of fingerprints, joined on blocks, verified by Hamming distance."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate, combinations, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from incidence.llm.bytewords import blocks
from incidence.llm.common import lists, materialize, splitmix, unused
from incidence.llm.components import connected_components

#: Members of a block group that one task compares with each other; larger groups are dealt out as pairs of chunks.
CHUNK = 4096
#: Members of a group that chance may put together, on average.
BY_CHANCE = 4096
#: Rows that a group's comparison takes at a time.
ROWS = 256
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 (seed 42) of all runs of `size` words, repeats included; of all words where there are fewer."""
    if not words:
        return np.zeros(0, np.uint64)
    joined, ends = b" ".join(words), list(accumulate(len(w) + 1 for w in words))
    starts, last = [0, *ends], max(0, len(words) - size)
    shift = min(size, len(words)) - 1
    return np.fromiter((xxhash.xxh64_intdigest(joined[starts[i] : ends[i + shift] - 1], 42) for i in range(last + 1)), np.uint64, last + 1)


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)
    return int(np.packbits(ones, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, key: str, text: str, shingle: int = 4) -> DataFrame:
    """_key, fp (64 bits as a long): one row per row of `df`; keys of any type, null too, pass as they are.

    A-Z are lower-cased; words are runs without space and tab to carriage return. fp is the SimHash of the XXH64 hashes
    of `shingle`-word shingles, repeats included. Null and empty texts have no shingle: all bits are 0.
    """

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            words = (body.encode().lower().split() if body else [] for body in frame["_text"].to_pylist())
            fps = np.array([majority(shingle_hashes(w, shingle)) for w in words], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([frame["_key"], pa.array(fps)], ["_key", "fp"])

    rows = df.select(df[key].alias("_key"), df[text].alias("_text"))
    return rows.mapInArrow(batches, f"_key {dict(rows.dtypes)['_key']}, fp long")


def _runs(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the set of runs of `size` words; of all words where there are fewer."""
    n = max(1, len(words) - size + 1)
    mixed = np.zeros(n, np.uint64)
    for i in range(min(size, len(words))):
        mixed = splitmix(mixed + words[i : i + n] + _GOLDEN)
    return np.unique(mixed)


def set_fingerprints(df: DataFrame, key: str, text: str, shingle: int, near: tuple[int, ...], wide: int) -> DataFrame:
    """_key, _text_id, fps (an array of longs), sig (binary): one row per row of `df`.

    fps has a SimHash of 64 bits over the set of n-word shingles for each n of `near`, sig one of 64 * `wide` bits over
    the set of `shingle`-word shingles. Words as in `fingerprints`; _text_id is a hash of the text, null as empty.
    """

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            fps, sigs = np.zeros((frame.num_rows, len(near)), np.uint64), [bytes(8 * wide)] * frame.num_rows
            for block in blocks(frame["_text"], lower=True):
                for i, (a, b) in enumerate(pairwise(block.bounds)):
                    if a == b:
                        continue
                    words, row = block.hashes[a:b], block.first + i
                    fps[row] = [majority(_runs(words, n)) for n in near]
                    runs = _runs(words, shingle)
                    sigs[row] = b"".join(majority(splitmix(runs + _GOLDEN * np.uint64(k + 1))).to_bytes(8, "little") for k in range(wide))
            columns = [frame["_key"], frame["_text_id"], lists(list(fps.view(np.int64)), pa.int64()), pa.array(sigs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["_key", "_text_id", "fps", "sig"])

    body = F.coalesce(df[text], F.lit(""))
    rows = df.select(df[key].alias("_key"), F.xxhash64(body).alias("_text_id"), body.alias("_text"))
    return rows.mapInArrow(batches, f"_key {dict(rows.dtypes)['_key']}, _text_id long, fps array<long>, sig binary")


def _labels(fp: np.ndarray, sig: np.ndarray, side: np.ndarray, bits: int, wide_bits: int) -> np.ndarray:
    """For each member of a group the first member of its component in the group; members of one side meet those of the other (0 and 1), or all meet (all 0).

    Some rows at a time are compared with all before them, and the pairs found are merged at once, so that a dense
    group needs no room for its pairs.
    """
    label = np.arange(len(fp))
    apart = side.any()
    for a in range(0, len(fp), ROWS):
        b = min(a + ROWS, len(fp))
        i, j = np.nonzero(np.bitwise_count(fp[a:b, None] ^ fp[None, :b]) <= bits)
        i += a
        keep = j < i
        if apart:
            keep &= side[i] != side[j]
        i, j = i[keep], j[keep]
        if sig.shape[1] and len(i):
            keep = np.bitwise_count(sig[i] ^ sig[j]).sum(axis=1) <= wide_bits
            i, j = i[keep], j[keep]
        while len(i):
            x, y = label[i], label[j]
            differ = x != y
            if not differ.any():
                break
            x, y = x[differ], y[differ]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (label[label] != label).any():
                label = label[label]
    return label


def _linked(bits: int, wide_bits: int):
    """Batches sorted by group -> (a, b): each linked member with the first of its component in the group."""
    cols = ["_c", "_masked", "_i", "_j"]

    def links(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for frame in frames:
            rows = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            ids = rows[cols].to_numpy()
            cuts = np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1
            at = cuts[-1] if len(cuts) else 0
            rest = rows.iloc[at:]
            yield groups(rows.iloc[:at], np.r_[0, cuts] if at else np.zeros(1, np.int64))
        if rest is not None and len(rest):
            yield groups(rest.reset_index(drop=True), np.array([0, len(rest)]))

    def groups(rows: pd.DataFrame, bounds: np.ndarray) -> pd.DataFrame:
        node, fp = rows["_node"].to_numpy(), rows["fp"].to_numpy().view(np.uint64)
        side = (rows["_s"] != rows["_i"]).to_numpy().astype(np.int8)
        wide = len(rows["sig"].iloc[0]) if len(rows) else 0
        sig = np.frombuffer(b"".join(rows["sig"]), "<u8").reshape(len(rows), wide // 8) if wide else np.zeros((len(rows), 0), np.uint64)
        a, b = [], []
        sizes = np.diff(bounds)
        twos = bounds[:-1][sizes == 2]
        if len(twos):  # most groups that chance makes
            ok = np.bitwise_count(fp[twos] ^ fp[twos + 1]) <= bits
            if wide:
                ok &= np.bitwise_count(sig[twos] ^ sig[twos + 1]).sum(axis=1) <= wide_bits
            ok &= (rows["_i"].to_numpy()[twos] == rows["_j"].to_numpy()[twos]) | (side[twos] != side[twos + 1])
            a.append(node[twos][ok])
            b.append(node[twos + 1][ok])
        for start, size in zip(bounds[:-1][sizes > 2], sizes[sizes > 2], strict=True):
            s = slice(start, start + size)
            label = _labels(fp[s], sig[s], side[s], bits, wide_bits)
            moved = np.flatnonzero(label != np.arange(size))
            if len(moved):
                a.append(node[s][moved])
                b.append(node[s][label[moved]])
        return pd.DataFrame({"a": np.concatenate(a) if a else np.zeros(0, np.int64), "b": np.concatenate(b) if b else np.zeros(0, np.int64)})

    return links


def _masks(bits: int, n: int) -> list[int]:
    """Masks of which one at least leaves two fingerprints equal that differ in `bits` bits at most.

    With bits + r blocks, r of them are free of any difference. r grows with the number of fingerprints, so that chance
    puts about BY_CHANCE into a group at most.
    """
    r = 1
    while r < 8 and 2 ** (64 * r / (bits + r)) < n / BY_CHANCE:
        r += 1
    m = bits + r
    edges = [64 * k // m for k in range(m + 1)]
    blocks = [((1 << edges[k + 1]) - 1) ^ ((1 << edges[k]) - 1) for k in range(m)]
    return [sum(c) for c in combinations(blocks, r)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def component_table(prints: DataFrame, bits: int, wide_bits: int = 0) -> DataFrame:
    """fps, sig, _component: one row per distinct fps and sig, with a number that components have of their own.

    Equal fingerprints are one node, so copies cost one row. Nodes link if one of the fps differs in `bits` bits at
    most and sig in `wide_bits`. A group of equal blocks with more than CHUNK members is split by a hash of the member,
    and every pair of chunks is compared in a task of its own; what a task emits are the components in its group, not
    the pairs.
    """
    nodes = prints.groupBy("fps", "sig").count().select("fps", "sig", F.monotonically_increasing_id().alias("_node"))
    nodes = materialize(nodes, "fingerprints")
    masks = _masks(bits, nodes.count())
    at = [F.struct(F.lit(i).alias("_c"), F.lit(_signed(m)).alias("_mask")) for i, m in enumerate(masks)]
    each = nodes.select("_node", "sig", F.posexplode("fps").alias("_which", "fp"))
    blocks = each.select("fp", "sig", "_node", "_which", F.inline(F.array(*at))).select(
        (F.col("_which") * len(masks) + F.col("_c")).alias("_c"), F.col("fp").bitwiseAND(F.col("_mask")).alias("_masked"), "fp", "sig", "_node"
    )
    hot = materialize(blocks.groupBy("_c", "_masked").count().where(F.col("count") > CHUNK), "hot-blocks")
    chunks = F.ceil(F.coalesce("count", F.lit(1)) / CHUNK).cast("int")
    dealt = blocks.join(hot, ["_c", "_masked"], "left").withColumn("_g", chunks)
    dealt = dealt.withColumn("_s", F.pmod(F.xxhash64("_node"), F.col("_g")).cast("int"))
    dealt = dealt.withColumn("_t", F.explode(F.sequence(F.lit(0), F.col("_g") - 1)))
    dealt = dealt.select("_c", "_masked", F.least("_s", "_t").alias("_i"), F.greatest("_s", "_t").alias("_j"), "_s", "fp", "sig", "_node")
    cells = dealt.repartition("_c", "_masked", "_i", "_j").sortWithinPartitions("_c", "_masked", "_i", "_j", "_node")
    links = cells.mapInPandas(_linked(bits, wide_bits), "a long, b long")
    found = connected_components(links, "a", "b")
    return nodes.join(found, nodes["_node"] == found["node"], "left").select("fps", "sig", F.coalesce("component", "_node").alias("_component"))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", bits: int = 4, shingle: int = 4) -> DataFrame:
    """key, fp, component_id for every row of `df`: the smallest key of the row's near-duplicate component.

    Rows link whose fingerprints differ in `bits` bits at most. Keys are of any type that has an order; a null key
    links like any other, but is a component's id only if no other is in it. Texts without words have fingerprint 0 and
    link like any other. Nothing but fingerprints moves. No rows: an empty result.
    """
    prints = materialize(fingerprints(df, key, text, shingle), "prints").withColumns({"fps": F.array("fp"), "sig": F.lit(b"")})
    least = prints.groupBy("fps", "sig").agg(F.min("_key").alias("_least"))
    table = component_table(prints, bits).join(least, ["fps", "sig"])
    ids = table.groupBy("_component").agg(F.min("_least").alias("component_id"))
    ids = table.join(ids, "_component").select(F.col("fps")[0].alias("fp"), "component_id")
    return prints.join(ids, "fp").select(F.col("_key").alias(key), "fp", "component_id")


def bits_apart(similarity: float, bits: int, deviations: float) -> int:
    """Bits by which fingerprints of sets of this Jaccard similarity differ, some standard deviations above the mean."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.floor(bits * p + deviations * math.sqrt(bits * p * (1 - p)))


def one_of_each(
    df: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = 0.8, shingle: int = 5, near: tuple[int, ...] = (1, 2), bits: int = 8, wide: int = 8, deviations: float = 2.0
) -> DataFrame:
    """The rows of `df`, all columns: of every near-duplicate component the row with the smallest key.

    Fingerprints of the sets of single words and of word pairs find the rows that may be alike (a word changed in fifty
    changes few of their bits, but a tenth of the five-word shingles); 64 * `wide` bits over the set of `shingle`-word
    shingles verify them: they may differ by what `similarity` makes differ and `deviations` standard deviations more,
    so that 98 of 100 pairs of just this similarity pass. Null keys come after all others. Of rows with equal keys and
    different texts that are no near-duplicates all stay; of rows with equal key and text one stays, always the same.
    """
    prints = materialize(set_fingerprints(df, key, text, shingle, near, wide), "prints")
    rank = F.struct(F.col("_key").isNull().alias("_last"), "_key", "_text_id")
    least = prints.groupBy("fps", "sig").agg(F.min(rank).alias("_row"))
    table = component_table(prints, bits, bits_apart(similarity, 64 * wide, deviations)).join(least, ["fps", "sig"])
    first = table.groupBy("_component").agg(F.min("_row").alias("_row")).select("_row._key", "_row._text_id")
    same = (prints["_key"].eqNullSafe(first["_key"])) & (prints["_text_id"] == first["_text_id"])
    first = materialize(prints.join(first, same, "left_semi").groupBy("_key", "_text_id").count(), "kept")
    hashed = F.xxhash64(F.coalesce(df[text], F.lit("")))
    out = df.join(first.hint("merge"), (hashed == first["_text_id"]) & df[key].eqNullSafe(first["_key"]), "left_semi")
    if first.where("count > 1").isEmpty():
        return out
    (place,) = unused(df, "_place")
    order = Window.partitionBy(key, F.xxhash64(F.coalesce(F.col(text), F.lit("")))).orderBy(F.xxhash64(*df.columns))
    return out.withColumn(place, F.row_number().over(order)).where(F.col(place) == 1).drop(place)


def hex_digits(fp: Column) -> Column:
    """16 lower-case hex digits of a long taken as unsigned."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
