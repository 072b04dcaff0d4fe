"""Chat formatting: conversations rendered by a compiled template, and read back."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incidence.llm.template import compile_template

TEMPLATE = """{% for turn in turns %}<turn role={{ turn.role | escape }}>
{% if turn.role == 'assistant' %}{% generation %}{{ turn.text | escape }}{% endgeneration %}{% else %}{{ turn.text | escape }}{% endif %}</turn>
{% endfor %}"""
#: The same for one turn, whose forms put together are the conversation's.
TURN_TEMPLATE = TEMPLATE.removeprefix("{% for turn in turns %}").removesuffix("{% endfor %}")
CONTROL = ("<turn role=", ">\n", "</turn>\n")
#: Turns that are Python objects at a time.
SLICE = 256
_TURN = re.compile(r"<turn role=([^<>]*)>\n([^<>]*)</turn>\n")


def format_conversations(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", template: str = TEMPLATE, control: tuple[str, ...] = CONTROL) -> DataFrame:
    """key, formatted, loss_spans: one row per conversation, its turns in order, loss_spans in code points [from, to).

    Turns with equal numbers (repeated rows too) all stay, ordered by role and text; null numbers come first. Null
    roles and texts are empty. A conversation is formatted as a whole, in one row; empty tables give no rows.
    """
    turns = df.select(
        df[key].alias("_key"), F.struct(df[turn].alias("turn"), F.coalesce(df[role], F.lit("")).alias("role"), F.coalesce(df[text], F.lit("")).alias("text")).alias("_turn")
    )
    whole = turns.groupBy("_key").agg(F.sort_array(F.collect_list("_turn")).alias("turns"))

    span = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        show, _ = compile_template(template, control)
        for batch in batches:
            out = [show({"turns": turns}) for turns in batch["turns"].to_pylist()]
            spans = pa.array([[{"from": a, "to": b} for a, b in o.spans] for o in out], span)
            yield pa.RecordBatch.from_arrays([batch["_key"], pa.array([o.text for o in out], pa.string()), spans], ["_key", "formatted", "loss_spans"])

    kind = dict(turns.dtypes)["_key"]
    return whole.mapInArrow(render, f"_key {kind}, formatted string, loss_spans array<struct<from:int,to:int>>").withColumnRenamed("_key", key)


def format_turns(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", template: str = TURN_TEMPLATE, control: tuple[str, ...] = CONTROL) -> DataFrame:
    """key, nr, start, formatted, loss_spans: one row per turn, whose forms in order of nr make up the conversation.

    start and loss_spans are code points of the whole conversation. Order, null and repeated turns are as in
    `format_conversations`. Turns stream through a task sorted by conversation, so none holds a conversation; the
    template is for one turn and knows nothing of the others.
    """
    rows = df.select(df[key].alias("_key"), df[turn].alias("_turn"), F.coalesce(df[role], F.lit("")).alias("_role"), F.coalesce(df[text], F.lit("")).alias("_text"))
    rows = rows.repartition("_key").sortWithinPartitions("_key", "_turn", "_role", "_text")
    span = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        show, _ = compile_template(template, control)
        last, nr, start = object(), 0, 0
        for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            out = []
            for at, number, who, said in zip(*(batch[c].to_pylist() for c in ("_key", "_turn", "_role", "_text")), strict=True):
                if at != last:
                    last, nr, start = at, 0, 0
                told = show({"turn": {"turn": number, "role": who, "text": said}})
                out.append((nr, start, told.text, [{"from": start + a, "to": start + b} for a, b in told.spans]))
                nr, start = nr + 1, start + len(told.text)
            columns = [pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), span), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["_key"], *columns], ["_key", "nr", "start", "formatted", "loss_spans"])

    kind = dict(rows.dtypes)["_key"]
    return rows.mapInArrow(render, f"_key {kind}, nr long, start long, formatted string, loss_spans array<struct<from:bigint,to:bigint>>").withColumnRenamed("_key", key)


def read_back_turns(df: DataFrame, key: str = "conv_id", control: tuple[str, ...] = CONTROL) -> DataFrame:
    """What `read_back` gives, from the rows of `format_turns`; digests grow turn by turn."""
    rows = df.withColumnRenamed(key, "_key").select("_key", "nr", "start", "formatted", "loss_spans").repartition("_key").sortWithinPartitions("_key", "nr")
    kinds = {"n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64()}

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, escape = compile_template("", control)
        last, state = object(), None

        def told(states: list, keys: pa.DataType) -> pa.RecordBatch:
            values = [(n, said.hexdigest(), chars, loss.hexdigest(), end) for _, n, said, chars, loss, end in states]
            return pa.RecordBatch.from_arrays([pa.array([s[0] for s in states], keys), *(pa.array(c, k) for c, k in zip(zip(*values, strict=True), kinds.values(), strict=True))], ["_key", *kinds])

        for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            done, keys = [], batch["_key"].type
            for at, start, formatted, spans in zip(*(batch[c].to_pylist() for c in ("_key", "start", "formatted", "loss_spans")), strict=True):
                if state is None or at != last:
                    done += [state] if state else []
                    last, state = at, [at, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                if state[5] != start:
                    raise ValueError("a turn is missing")
                for who, said in read_turns(formatted, escape.undo):
                    state[1] += 1
                    state[2].update(f"{who}\n{said}\n".encode())
                for s in spans:
                    lost = escape.undo(formatted[s["from"] - start : s["to"] - start])
                    state[3] += len(lost)
                    state[4].update(lost.encode())
                state[5] += len(formatted)
            if done:
                yield told(done, keys)
        if state:
            yield told([state], keys)

    kind = dict(rows.dtypes)["_key"]
    return rows.mapInArrow(digest, f"_key {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").withColumnRenamed("_key", key)


def read_turns(formatted: str, undo) -> list[tuple[str, str]]:
    """(role, text) of each turn of a text in the form of TEMPLATE; anything else in it is an error."""
    turns, end = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != end:
            raise ValueError("text outside the turns")
        turns.append((undo(m[1]), undo(m[2])))
        end = m.end()
    if end != len(formatted):
        raise ValueError("text after the turns")
    return turns


def read_back(df: DataFrame, key: str = "conv_id", control: tuple[str, ...] = CONTROL) -> DataFrame:
    """key, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from formatted and loss_spans alone."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, escape = compile_template("", control)
        kinds = {"n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64()}
        for batch in batches:
            rows = {c: [] for c in kinds}
            for formatted, spans in zip(batch["formatted"].to_pylist(), batch["loss_spans"].to_pylist(), strict=True):
                turns = read_turns(formatted, escape.undo)
                loss = "".join(escape.undo(formatted[s["from"] : s["to"]]) for s in spans)
                said = "".join(f"{r}\n{t}\n" for r, t in turns)
                for column, value in zip(rows.values(), (len(turns), _sha256(said), len(loss), _sha256(loss), len(formatted)), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch["_key"], *(pa.array(v, kinds[c]) for c, v in rows.items())], ["_key", *kinds])

    kind = dict(df.dtypes)[key]
    out = df.withColumnRenamed(key, "_key").select("_key", "formatted", "loss_spans")
    return out.mapInArrow(digest, f"_key {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").withColumnRenamed("_key", key)


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()
