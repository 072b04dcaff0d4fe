"""Quality classifier: gated attention over a document's passages, learned from labels of whole documents."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from incidence.llm.bytewords import Block, blocks
from incidence.llm.common import unused

#: Words of a passage; the last one of a text may be shorter.
PASSAGE = 64
HIDDEN, GATE = 32, 16

# Kinds of bytes that a passage's histograms tell apart.
_KINDS = ("space", "newline", "lower", "upper", "digit", "stop", "exclaim", "comma", "joint", "symbol", "lead", "tail")
_KIND = np.zeros(256, np.int64)
_KIND[33:127] = _KINDS.index("symbol")
for _name, _bytes in {"newline": b"\n", "lower": bytes(range(97, 123)), "upper": bytes(range(65, 91)), "digit": b"0123456789", "stop": b".?", "exclaim": b"!", "comma": b",;:", "joint": b"-'\"()"}.items():
    _KIND[list(_bytes)] = _KINDS.index(_name)
_KIND[0x80:0xC0], _KIND[0xC0:] = _KINDS.index("tail"), _KINDS.index("lead")
N_KINDS = len(_KINDS)
#: Features of a passage: pairs of neighbouring bytes' kinds, then five figures of its words.
FEATURES = N_KINDS * N_KINDS + 5


def encode(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(passages x FEATURES, first passage of each text and their number) of a block; a text without words has one empty passage.

    A passage's bytes run from its first word to the next passage; its pairs of byte kinds count as square roots of
    shares, so that rare kinds show. Its words' figures: mean length, share equal to the word before, share seen
    earlier in the passage, fill, and whether there is any word.
    """
    words = np.diff(block.bounds)
    passages = np.maximum(1, -(-words // PASSAGE))
    heads = np.r_[0, np.cumsum(passages)]
    owner = np.repeat(np.arange(len(words)), passages)
    rank = np.arange(heads[-1]) - heads[owner]
    first_word = np.minimum(block.bounds[owner] + rank * PASSAGE, block.bounds[owner + 1])
    n_words = np.minimum(PASSAGE, block.bounds[owner + 1] - first_word)
    # Bytes of passages: the first one of a text starts with the text.
    starts = np.r_[block.starts, len(block.blob)]
    begin = np.where(rank == 0, block.cuts[owner], starts[np.minimum(first_word, len(starts) - 1)])
    size = np.diff(np.r_[begin, len(block.blob)])
    kind = _KIND[block.blob]
    of_byte = np.repeat(np.arange(heads[-1]), size)
    pair = np.r_[0, kind[:-1]] * N_KINDS + kind if len(kind) else kind
    if len(pair):
        at = begin[size > 0]
        pair[at] = kind[at]  # before a passage there is space
    counts = np.bincount(of_byte * (N_KINDS * N_KINDS) + pair, minlength=heads[-1] * N_KINDS * N_KINDS).reshape(heads[-1], -1)
    out = np.empty((heads[-1], FEATURES), np.float32)
    out[:, :-5] = np.sqrt(counts / np.maximum(size, 1)[:, None])
    of_word = np.repeat(np.arange(heads[-1]), n_words)
    h = block.hashes
    follows = np.zeros(len(h), bool)
    follows[1:] = (h[1:] == h[:-1]) & (of_word[1:] == of_word[:-1])
    order = np.lexsort((h, of_word))
    seen = np.zeros(len(h), bool)
    seen[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (of_word[order[1:]] == of_word[order[:-1]])
    n = np.maximum(n_words, 1)
    out[:, -5] = np.log1p(size / n) / 4
    out[:, -4] = np.bincount(of_word[follows], minlength=heads[-1]) / n
    out[:, -3] = np.bincount(of_word[seen], minlength=heads[-1]) / n
    out[:, -2] = n_words / PASSAGE
    out[:, -1] = n_words > 0
    return out, heads


@dataclass
class Model:
    """Weights: encoder, the attention's two gates and its direction, the score; and how features are scaled."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def scaled(self, passages: np.ndarray) -> np.ndarray:
        return np.clip((passages - self.mean) / self.scale, -8, 8)

    def score(self, passages: np.ndarray, heads: np.ndarray) -> np.ndarray:
        return np.round(_forward(self.weights, self.scaled(passages), heads)["p"], 9)


def _forward(w: dict[str, np.ndarray], x: np.ndarray, heads: np.ndarray) -> dict[str, np.ndarray]:
    """Passages are encoded, gated attention weighs them within their document, and the weighted mean is scored."""
    h = np.tanh(x @ w["encode"] + w["encode_bias"])
    tilt, gate = np.tanh(h @ w["tilt"]), 1 / (1 + np.exp(-(h @ w["gate"])))
    logit = (tilt * gate) @ w["attend"]
    owner = np.repeat(np.arange(len(heads) - 1), np.diff(heads))
    e = np.exp(logit - np.maximum.reduceat(logit, heads[:-1])[owner])
    a = e / np.add.reduceat(e, heads[:-1])[owner]
    z = np.add.reduceat(a[:, None] * h, heads[:-1], axis=0)
    p = 1 / (1 + np.exp(-np.clip(z @ w["score"] + w["score_bias"][0], -30, 30)))
    return {"h": h, "tilt": tilt, "gate": gate, "a": a, "z": z, "p": p, "owner": owner}


def _gradients(w: dict[str, np.ndarray], x: np.ndarray, heads: np.ndarray, y: np.ndarray, importance: np.ndarray, decay: float) -> dict[str, np.ndarray]:
    """Of the weighted cross-entropy plus `decay` / 2 times the squared weights."""
    f = _forward(w, x, heads)
    d = importance * (f["p"] - y) / importance.sum()
    owner, h, a = f["owner"], f["h"], f["a"]
    by_z = d[:, None] * w["score"]
    worth = (by_z[owner] * h).sum(1)
    by_logit = a * (worth - np.add.reduceat(a * worth, heads[:-1])[owner])
    by_tilt = by_logit[:, None] * w["attend"] * f["gate"] * (1 - f["tilt"] ** 2)
    by_gate = by_logit[:, None] * w["attend"] * f["tilt"] * f["gate"] * (1 - f["gate"])
    by_h = (a[:, None] * by_z[owner] + by_tilt @ w["tilt"].T + by_gate @ w["gate"].T) * (1 - h**2)
    found = {
        "encode": x.T @ by_h, "encode_bias": by_h.sum(0), "tilt": h.T @ by_tilt, "gate": h.T @ by_gate,
        "attend": (f["tilt"] * f["gate"]).T @ by_logit, "score": f["z"].T @ d, "score_bias": np.array([d.sum()]),
    }
    return {k: g + (0 if k.endswith("bias") else decay) * w[k] for k, g in found.items()}


def fit(passages: np.ndarray, heads: np.ndarray, labels: np.ndarray, epochs: int = 30, batch: int = 64, rate: float = 0.01, decay: float = 1e-3, seed: int = 11) -> Model:
    """Weights by Adam on shuffled batches of documents, both labels weighing the same; repeatable for a seed."""
    rng = np.random.default_rng(seed)
    mean, scale = passages.mean(0), passages.std(0)
    scale = np.where(scale > 1e-3, scale, 1.0).astype(np.float32)
    model = Model(mean, scale, {})
    x = model.scaled(passages)
    draw = lambda *shape: (rng.normal(0, 1, shape) / np.sqrt(shape[0])).astype(np.float64)
    w = {
        "encode": draw(FEATURES, HIDDEN), "encode_bias": np.zeros(HIDDEN), "tilt": draw(HIDDEN, GATE), "gate": draw(HIDDEN, GATE),
        "attend": draw(GATE), "score": draw(HIDDEN), "score_bias": np.zeros(1),
    }
    y = labels.astype(np.float64)
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6) if len(y) else 0.5
    importance = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
    first = {k: np.zeros_like(v) for k, v in w.items()}
    second = {k: np.zeros_like(v) for k, v in w.items()}
    step = 0
    for _ in range(epochs if len(y) else 0):
        order = rng.permutation(len(y))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            size = heads[some + 1] - heads[some]
            bag = np.r_[0, np.cumsum(size)]
            rows = np.repeat(heads[some] - bag[:-1], size) + np.arange(bag[-1])
            step += 1
            for k, g in _gradients(w, x[rows], bag, y[some], importance[some], decay).items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                w[k] -= rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    model.weights = w
    return model


def _encoded(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for block in blocks(texts.fill_null("")):
        yield encode(block)


def labelled_bags(df: DataFrame, labels: DataFrame, max_rows: int, max_bytes: int, key: str = "doc_id", text: str = "text") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passages, heads, labels) of the documents to learn from, gathered on the driver.

    Documents whose crc32 of the key is no multiple of five and whose label is known (of several labels of a key the
    least), at most about `max_rows` of them, chosen by a hash of the key, without those over `max_bytes` of text,
    which would make the sample's size unbounded. Their texts are taken whole and encoded in tasks.
    """
    known = labels.where(F.col("quality").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)).groupBy(F.col("doc_id").alias("_key")).agg(F.min("quality").alias("_label"))
    total = known.count()
    chosen = known.where(F.pmod(F.xxhash64("_key"), F.lit(1 << 30)) < int(min(1.0, max_rows / max(total, 1)) * (1 << 30)))
    rows = df.select(df[key].alias("_key"), F.coalesce(df[text], F.lit("")).alias("_text")).where(F.octet_length("_text") <= max_bytes).join(chosen, "_key")

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [(f[a:b].astype("<f4").tobytes()) for f, heads in _encoded(batch["_text"]) for a, b in zip(heads, heads[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch["_key"], batch["_label"].cast(pa.int32()), pa.array(parts, pa.binary())], ["_key", "_label", "_bag"])

    kind = dict(rows.dtypes)["_key"]
    bags = rows.mapInArrow(told, f"_key {kind}, _label int, _bag binary").toArrow()
    cells = sorted(zip(bags["_key"].to_pylist(), bags["_bag"].to_pylist(), bags["_label"].to_pylist(), strict=True))
    passages = np.frombuffer(b"".join(c[1] for c in cells), "<f4").reshape(-1, FEATURES)
    heads = np.r_[0, np.cumsum([len(c[1]) // (4 * FEATURES) for c in cells])].astype(np.int64)
    return passages, heads, np.array([c[2] for c in cells], np.int64)


def learn(df: DataFrame, labels: DataFrame, max_rows: int = 4_000, max_bytes: int = 1 << 15, key: str = "doc_id", text: str = "text", **how) -> Model:
    """The model for `quality` of `labels`. `max_rows` and `max_bytes` bound what it is fitted on; without labels it scores 0.5 or so."""
    passages, heads, y = labelled_bags(df, labels, max_rows, max_bytes, key, text)
    if not len(y):
        passages = np.zeros((1, FEATURES), np.float32)
    return fit(passages, heads, y, **how)


def with_scores(df: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """All columns of `df` and `score` (0 to 1, higher: label 1 likelier), from every passage of the whole text.

    Null texts are empty; a text without words is scored as one empty passage. Equal texts have equal scores, and
    a clashing column of the score's name is an error.
    """
    if score.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"there is a column {score}")
    context = df.sparkSession.sparkContext
    sent = context.broadcast(model)  # a few thousand weights

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [sent.value.score(f, heads) for f, heads in _encoded(batch[text])]
            scores = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, score])

    return df.mapInArrow(told, T.StructType([*df.schema.fields, T.StructField(score, T.DoubleType())]))


def quality_scores(df: DataFrame, labels: DataFrame, threshold: float = 0.3, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """key, held_out, score, predicted: one row per row of `df`.

    held_out: crc32 of the key as text is a multiple of five (null keys: of the empty text, which is one); their labels
    are never learned from. predicted is 1 if score reaches `threshold`. Scores depend on texts alone. An empty table
    gives no rows; other columns of `df` are ignored.
    """
    model = learn(df, labels, key=key, text=text, **how)
    name = unused(df, "_text")[0]
    rows = df.select(df[key].alias(key), F.coalesce(df[text], F.lit("")).alias(name))
    held_out = F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 5 == 0
    scored = with_scores(rows, model, name)
    return scored.select(key, held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
