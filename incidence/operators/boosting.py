"""Boosted trees for several classes, and exact Shapley values of their predictions."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from incidence.sources.files import materialize

#: Bins of a feature; the first holds nulls and categories that training did not see.
BINS = 32
#: Rows of a packed record, rows that a task works on at a time, and trees after which the rows' margins are written anew.
PACKED, AT_ONCE, KEPT = 256, 65_536, 10


@dataclass
class Tree:
    """Nodes in the order of their making; a leaf has feature -1. A row goes left if its bin is at most the cut."""

    feature: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[np.ndarray] = field(default_factory=list)  # a margin per class, at leaves
    cover: list[float] = field(default_factory=list)  # weight of the training rows

    def add(self, value: np.ndarray, cover: float) -> int:
        for column, x in ((self.feature, -1), (self.cut, 0), (self.left, -1), (self.right, -1), (self.value, value), (self.cover, cover)):
            column.append(x)
        return len(self.feature) - 1

    def leaves_of(self, bins: np.ndarray) -> np.ndarray:
        def walk(node: int) -> np.ndarray | np.int32:
            if self.feature[node] < 0:
                return np.int32(node)
            return np.where(bins[:, self.feature[node]] <= self.cut[node], walk(self.left[node]), walk(self.right[node]))

        return np.broadcast_to(walk(0), len(bins))


@dataclass
class Model:
    """Features with their bins, classes, the margins to start from, and trees; losses: (training, validation) per round."""

    numbers: dict[str, np.ndarray]  # feature -> ascending cuts
    categories: dict[str, dict[str, int]]  # feature -> value -> bin
    classes: tuple[str, ...]
    start: np.ndarray
    trees: list[Tree] = field(default_factory=list)
    losses: list[tuple[float, float]] = field(default_factory=list)

    @property
    def features(self) -> list[str]:
        return [*self.numbers, *self.categories]

    def bins(self, batch: pa.RecordBatch) -> np.ndarray:
        out = np.zeros((batch.num_rows, len(self.features)), np.uint8)
        for i, (name, cuts) in enumerate(self.numbers.items()):
            x = batch[name].cast(pa.float64()).to_numpy(zero_copy_only=False)
            out[:, i] = np.where(np.isnan(x), 0, 1 + np.searchsorted(cuts, x, side="left"))
        for i, (name, places) in enumerate(self.categories.items(), len(self.numbers)):
            values = batch[name].dictionary_encode()
            known = np.array([places.get(v, 0) for v in values.dictionary.to_pylist()] + [0], np.uint8)
            out[:, i] = known[values.indices.fill_null(len(known) - 1).to_numpy()]
        return out

    def margins(self, bins: np.ndarray) -> np.ndarray:
        return _moved(np.tile(self.start, (len(bins), 1)), self.trees, bins)


def _moved(margins: np.ndarray, trees: Sequence[Tree], bins: np.ndarray) -> np.ndarray:
    """`margins`, which are changed, with the values of `trees` added."""
    for tree in trees:
        margins += np.stack(tree.value)[tree.leaves_of(bins)]
    return margins


def probabilities(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _binning(df: DataFrame, label: str, numbers: Sequence[str], categories: Sequence[str], classes: Sequence[str]) -> tuple[dict, dict]:
    """Cuts at quantiles, and categories (the most frequent ones, as many as there are bins) by the mean place of their class."""
    quantiles = [i / (BINS - 1) for i in range(1, BINS - 1)]
    row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), quantiles, 10_000).alias(c) for c in numbers]).first() if numbers else {}
    cuts = {c: np.unique(np.array(row[c] or [], np.float64)) for c in numbers}
    rank = F.array_position(F.array(*map(F.lit, classes)), F.col(label))
    places = {}
    for c in categories:
        most = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n"), F.avg(rank).alias("mean")).orderBy(F.desc("n"), c).limit(BINS - 2).collect()
        places[c] = {r[c]: k + 1 for k, r in enumerate(sorted(most, key=lambda r: (r["mean"], r[c])))}
    return cuts, places


def _unpacked(packed: pa.Array, n_features: int) -> np.ndarray:
    """The bins of all rows, read where Arrow holds them; every row has one byte per feature."""
    _, places, values = packed.buffers()
    if not len(packed) or values is None:
        return np.zeros((len(packed), n_features), np.uint8)
    start = np.frombuffer(places, np.int32)[packed.offset]
    return np.frombuffer(values, np.uint8)[start : start + len(packed) * n_features].reshape(-1, n_features)


_RECORDS = "bins binary, y binary, weight binary, valid binary, margins binary"


def _records(bins: np.ndarray, y: np.ndarray, weight: np.ndarray, valid: np.ndarray, margins: np.ndarray) -> pa.RecordBatch:
    """PACKED rows in a record, so that Spark passes few long values on, not many short ones."""
    columns = {"bins": bins.astype(np.uint8), "y": y.astype(np.uint8), "weight": weight.astype(np.float64), "valid": valid.astype(np.uint8), "margins": margins.astype(np.float64)}
    cut = lambda values: pa.array([values[i : i + PACKED].tobytes() for i in range(0, len(values), PACKED)], pa.binary())
    return pa.RecordBatch.from_arrays([cut(v) for v in columns.values()], list(columns))


def _rows(batches: Iterator[pa.RecordBatch], n_features: int, n_classes: int) -> Iterator[tuple[np.ndarray, ...]]:
    """bins, y, weight, valid, margins of AT_ONCE rows at most; a feature's bins lie side by side."""
    for batch in batches:
        for start in range(0, batch.num_rows, AT_ONCE // PACKED):
            part = batch.slice(start, AT_ONCE // PACKED)
            read = lambda name, kind: np.frombuffer(b"".join(part[name].to_pylist()), kind)  # noqa: B023, E731
            bins = np.ascontiguousarray(read("bins", np.uint8).reshape(-1, n_features).T).T
            yield bins, read("y", np.uint8).astype(np.int64), read("weight", np.float64), read("valid", np.bool_), read("margins", np.float64).reshape(-1, n_classes)


def _histograms(trees: Sequence[Tree], tree: Tree, open_nodes: Sequence[int], n_features: int, n_classes: int):
    """Records -> one row a task: per open node of `tree`, feature and bin the sums of gradients and curvatures per class, and at the root the losses.

    `trees` are those that the records' margins don't hold yet.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = np.full(len(tree.feature), -1)
        slot[open_nodes] = np.arange(len(open_nodes))
        cells = np.zeros((len(open_nodes), n_features, BINS, 2 * n_classes))
        losses = np.zeros(4)
        for bins, y, w, valid, margins in _rows(batches, n_features, n_classes):
            at = slot[tree.leaves_of(bins)]
            rows = np.flatnonzero((at >= 0) & ~valid)
            if len(tree.feature) == 1:
                p = probabilities(_moved(margins.copy(), trees, bins))
                loss = -w * np.log(np.maximum(p[np.arange(len(y)), y], 1e-15))
                losses += [loss[~valid].sum(), w[~valid].sum(), loss[valid].sum(), w[valid].sum()]
                bins, p = bins.T[:, rows].T, p[rows]
            else:
                bins = bins.T[:, rows].T
                p = probabilities(_moved(margins[rows], trees, bins))
            y, w, at = y[rows], w[rows, None], at[rows] * BINS
            gradient = w * p
            gradient[np.arange(len(y)), y] -= w[:, 0]
            both = np.ascontiguousarray(np.concatenate([gradient, w * p * (1 - p)], axis=1).T)
            for f in range(n_features):
                cell = at + bins[:, f]
                for k in range(2 * n_classes):
                    cells[:, f, :, k] += np.bincount(cell, both[k], minlength=len(cells) * BINS).reshape(-1, BINS)
        yield pa.RecordBatch.from_arrays([pa.array([cells.tobytes()], pa.binary()), pa.array([losses.tobytes()], pa.binary())], ["cells", "losses"])

    return run


def _advanced(trees: Sequence[Tree], n_features: int, n_classes: int):
    """Records -> the same with margins that hold `trees` too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bins, y, w, valid, margins in _rows(batches, n_features, n_classes):
            yield _records(bins, y, w, valid, _moved(margins.copy(), trees, bins))

    return run


def _best_split(sums: np.ndarray, n_classes: int, penalty: float, least: float) -> tuple[float, int, int, np.ndarray, np.ndarray] | None:
    """(gain, feature, cut, sums left, sums right) of a node from its (feature, bin, 2 * class) sums; None: no gain."""
    left = np.cumsum(sums, axis=1)
    whole = left[:1, -1:]
    right = whole - left
    worth = lambda s: (s[..., :n_classes] ** 2 / (s[..., n_classes:] + penalty)).sum(-1)
    gain = worth(left) + worth(right) - worth(whole)
    gain[(left[..., n_classes:].sum(-1) < least) | (right[..., n_classes:].sum(-1) < least)] = -np.inf
    feature, cut = np.unravel_index(np.argmax(gain), gain.shape)
    return (gain[feature, cut], int(feature), int(cut), left[feature, cut], right[feature, cut]) if gain[feature, cut] > 1e-9 else None


def fit(
    df: DataFrame,
    label: str,
    numbers: Sequence[str],
    categories: Sequence[str],
    classes: Sequence[str],
    valid: Column,
    rounds: int = 60,
    patience: int = 5,
    depth: int = 3,
    rate: float = 0.2,
    penalty: float = 1.0,
    least: float = 1.0,
) -> Model:
    """Additive trees on the softmax loss, one tree with a value per class each round, until the loss of `valid` rows hasn't fallen for `patience` rounds.

    Classes weigh the same: total / (classes * count). Features are cut into BINS bins at quantiles of the rows that aren't
    `valid`; nulls have a bin. Rows with equal bins and class are one row with their summed weight. A level of a tree is one
    pass: tasks, as many as there are cores, sum gradients and curvatures of their rows by node, feature and bin, and the
    driver adds the tasks' sums up. Rows carry their margins, which are written anew after KEPT trees, so that a pass walks
    fewer trees than that however many rounds there are.
    The trees after the best round are dropped. Rows with another label than `classes` are left out.
    """
    classes = tuple(classes)
    rows = df.where(F.col(label).isin(*classes)).withColumn("_valid", F.coalesce(valid, F.lit(False)))
    learn = materialize(rows.select(label, "_valid", *numbers, *categories))
    cuts, places = _binning(learn.where("not _valid"), label, numbers, categories, classes)
    counts = {r[label]: r["n"] for r in learn.where("not _valid").groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    weights = [sum(counts.values()) / (len(counts) * counts[c]) if c in counts else 0.0 for c in classes]
    n = len(classes)
    model = Model(cuts, places, classes, np.zeros(n))
    n_features = len(model.features)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {c: i for i, c in enumerate(classes)}
        for batch in batches:
            y = np.array([place[v] for v in batch[label].to_pylist()], np.int64)
            bins = [row.tobytes() for row in model.bins(batch)]
            yield pa.RecordBatch.from_arrays([pa.array(bins, pa.binary()), pa.array(y), batch["_valid"]], ["bins", "y", "valid"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, rows = batch["y"].to_numpy(), batch["n"].to_numpy()
            yield _records(_unpacked(batch["bins"], n_features), y, np.array(weights)[y] * rows, batch["valid"].to_numpy(zero_copy_only=False), np.tile(model.start, (len(y), 1)))

    n_tasks = df.sparkSession.sparkContext.defaultParallelism
    distinct = learn.mapInArrow(binned, "bins binary, y long, valid boolean").groupBy("bins", "y", "valid").agg(F.count(F.lit(1)).alias("n"))
    table = materialize(distinct.repartition(n_tasks).mapInArrow(packed, _RECORDS))
    held = 0  # trees that the margins of `table` hold

    def summed(tree: Tree, open_nodes: list[int]) -> tuple[np.ndarray, tuple[float, float]]:
        work = _histograms(model.trees[held:], tree, open_nodes, n_features, n)
        found = table.coalesce(n_tasks).mapInArrow(work, "cells binary, losses binary").collect()
        cells, losses = (sum((np.frombuffer(r[c], np.float64) for r in found), np.zeros(size)) for c, size in (("cells", len(open_nodes) * n_features * BINS * 2 * n), ("losses", 4)))
        return cells.reshape(-1, n_features, BINS, 2 * n), (float(losses[0] / max(losses[1], 1e-12)), float(losses[2] / max(losses[3], 1e-12)))

    best = (math.inf, 0)
    while True:
        tree = Tree()
        frontier = [tree.add(np.zeros(n), 0.0)]
        for level in range(depth):
            sums, losses = summed(tree, frontier)
            if level == 0:
                model.losses.append(losses)
                if losses[1] < best[0] - 1e-6:
                    best = (losses[1], len(model.trees))
                if len(model.trees) - best[1] >= patience or len(model.trees) == rounds:
                    model.trees, model.losses = model.trees[: best[1]], model.losses
                    return model
            grown = []
            for node, cells in zip(frontier, sums, strict=True):
                if level == 0:
                    tree.cover[node] = float(cells[0, :, n:].sum())
                split = _best_split(cells, n, penalty, least)
                if split is None:
                    continue
                _, tree.feature[node], tree.cut[node], *sides = split
                ends = [tree.add(-rate * s[:n] / (s[n:] + penalty), float(s[n:].sum())) for s in sides]
                tree.left[node], tree.right[node] = ends
                grown += ends
            frontier = grown
            if not frontier:
                break
        model.trees.append(tree)
        if len(model.trees) - held >= KEPT:
            table, held = materialize(table.mapInArrow(_advanced(model.trees[held:], n_features, n), _RECORDS)), len(model.trees)


def _with_bins(df: DataFrame, model: Model, columns: list[T.StructField], work) -> DataFrame:
    """All columns of `df` and `columns`, which `work` makes from the rows' bins."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = work(sent.value, sent.value.bins(batch))
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], [*batch.schema.names, *(c.name for c in columns)])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *columns]))


def _list(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel()))


def predicted(df: DataFrame, model: Model) -> DataFrame:
    """`df` with `proba` (one per class, in the model's order) and `predicted` (the likeliest class)."""
    names = np.array(model.classes)

    def work(m: Model, bins: np.ndarray) -> list[pa.Array]:
        p = probabilities(m.margins(bins))
        return [_list(p), pa.array(names[p.argmax(axis=1)].tolist(), pa.string())]

    return _with_bins(df, model, [T.StructField("proba", T.ArrayType(T.DoubleType())), T.StructField("predicted", T.StringType())], work)


# Attribution


def _paths(tree: Tree) -> list[tuple[np.ndarray, list[tuple[int, int, int, float]]]]:
    """Each leaf's value and per feature on its path (feature, bins over, bins to, share of the cover that stays on the path)."""
    out = []

    def walk(node: int, held: dict[int, tuple[int, int, float]]) -> None:
        f = tree.feature[node]
        if f < 0:
            out.append((tree.value[node], [(k, *v) for k, v in held.items()]))
            return
        low, high, share = held.get(f, (-1, 255, 1.0))
        for child, span in ((tree.left[node], (low, min(high, tree.cut[node]))), (tree.right[node], (max(low, tree.cut[node]), high))):
            walk(child, held | {f: (*span, share * tree.cover[child] / tree.cover[node])})

    walk(0, {})
    return out


def base(model: Model) -> np.ndarray:
    """The margins without knowledge of any feature: of each tree the mean of its leaves by cover."""
    out = model.start.astype(float).copy()
    for tree in model.trees:
        for value, path in _paths(tree):
            out += value * math.prod(share for *_, share in path)
    return out


def shapley(model: Model, bins: np.ndarray) -> np.ndarray:
    """(rows, features, classes): exact Shapley values of the margins; unknown features go both ways by cover.

    A leaf with d features on its path is worth its value times a factor per feature: whether the row stays on the path
    if the feature is known, the share of the cover that stays if not. So the sum over coalitions of k others is a
    coefficient of the product of (share + stays * t) over the other features, weighted k! (d - 1 - k)! / d!.
    """
    out = np.zeros((len(bins), len(model.features), len(model.classes)))
    for tree in model.trees:
        for value, path in _paths(tree):
            d = len(path)
            stays = [((bins[:, f] > low) & (bins[:, f] <= high)).astype(float) for f, low, high, _ in path]
            for i, (f, _, _, share) in enumerate(path):
                product = np.zeros((len(bins), d))
                product[:, 0] = 1.0
                for j, (*_, other) in enumerate(path):
                    if j != i:
                        product[:, 1:] = other * product[:, 1:] + stays[j][:, None] * product[:, :-1]
                        product[:, 0] *= other
                weights = np.array([math.factorial(k) * math.factorial(d - 1 - k) / math.factorial(d) for k in range(d)])
                out[:, f] += ((product @ weights) * (stays[i] - share))[:, None] * value
    return out


def attributed(df: DataFrame, model: Model) -> DataFrame:
    """`df` with `margins` (one per class) and `attribution` (features by classes, in the model's order): a class's column and its base add up to its margin."""
    n = len(model.classes)

    def work(m: Model, bins: np.ndarray) -> list[pa.Array]:
        values = shapley(m, bins).reshape(-1, n)
        inner = _list(values)
        outer = pa.ListArray.from_arrays(pa.array(np.arange(len(bins) + 1, dtype=np.int32) * len(m.features)), inner)
        return [_list(m.margins(bins)), outer]

    doubles = T.ArrayType(T.DoubleType())
    return _with_bins(df, model, [T.StructField("margins", doubles), T.StructField("attribution", T.ArrayType(doubles))], work)


def ranked(df: DataFrame, model: Model) -> DataFrame:
    """class, feature, mean_abs, place: the features by the mean size of their attribution over all rows of `df`."""
    names = F.array(*[F.lit(f) for f in model.features])
    cells = attributed(df, model).select(F.posexplode("attribution").alias("_f", "_values")).select(F.get(names, F.col("_f")).alias("feature"), F.posexplode("_values").alias("_k", "_value"))
    means = cells.groupBy(F.get(F.array(*[F.lit(c) for c in model.classes]), F.col("_k")).alias("class"), "feature").agg(F.avg(F.abs("_value")).alias("mean_abs"))
    return means.withColumn("place", F.row_number().over(Window.partitionBy("class").orderBy(F.desc("mean_abs"), "feature")).cast("long"))
