"""Conversation structure repair: the cheapest edits that give every conversation a legal order of roles."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incidence.llm.common import WHITES

# Roles so far: none, a system turn, ... and a user turn, ... and an assistant turn. Legal at the end: none, assistant.
NONE, SYSTEM, USER, ASSISTANT = range(4)
LEGAL_END = (NONE, ASSISTANT)
#: State and a turn's initial -> state; a pair that is missing is illegal.
FOLLOWS = {(NONE, "s"): SYSTEM, (NONE, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The one role that an inserted or renamed turn can have after a state, and the state that it gives.
NEXT_ROLE = {NONE: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
RENAME, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
ENDS = ".!?"
#: Turns of a segment, which one search settles; characters of a segment's texts; turn numbers that are searched in one task.
SEGMENT, SEGMENT_CHARS, CHUNK = 64, 1 << 20, 1024
#: Rows that are Python objects at a time.
SLICE = 128


@dataclass(frozen=True)
class Turn:
    """What the search knows of a turn: its role's initial, whether it must go, whether it costs more to stay."""

    initial: str
    must_go: bool = False
    truncated: bool = False


def _least(turn: Turn) -> int:
    """No edit of this turn is cheaper, whatever comes before it."""
    if turn.must_go:
        return DELETE
    stays = TRUNCATED if turn.truncated else 0
    return stays if turn.initial in ("s", "u", "a") else min(DELETE, stays + RENAME)


def _edits(turn: Turn | None, state: int) -> Iterator[tuple[str, int, int, int]]:
    """(initial, cost, state after it, turns used) of the edits possible at a turn (None: behind the last), ASCII-least first."""
    if turn is not None:
        yield "D", DELETE, state, 1
    yield "I", INSERT, NEXT_ROLE[state][1], 0
    if turn is not None and not turn.must_go:
        stays = TRUNCATED if turn.truncated else 0
        if (state, turn.initial) in FOLLOWS:
            yield "K", stays, FOLLOWS[state, turn.initial], 1
        yield "R", stays + RENAME, NEXT_ROLE[state][1], 1


def _greedy(turns: list[Turn], entry: int, end: int) -> tuple[int, str] | None:
    """Some edits from `entry` to `end` (user or assistant): keep what fits, rename or delete the rest, insert what is missing."""
    cost, audit, state = 0, "", entry
    for turn in turns:
        options = {e: (c, s) for e, c, s, _ in _edits(turn, state)}
        edit = "K" if "K" in options else "R" if "R" in options and options["R"][0] <= DELETE else "D"
        cost, audit, state = cost + options[edit][0], audit + edit, options[edit][1]
    while state != end:
        cost, audit, state = cost + INSERT, audit + "I", NEXT_ROLE[state][1]
    return cost, audit


def search(turns: list[Turn], entry: int) -> dict[int, tuple[int, str]]:
    """Per state at the end the cheapest (cost, audit) from state `entry`, of equal costs the ASCII-least audit.

    Depth-first branch and bound on an explicit stack. A node is (turns used, state). A prefix is cut if its cost and
    the least cost of the turns that are left (each for itself, whatever the state) can beat the incumbent of neither
    end, if it can only tie with a greater audit, or if the node's dominance table has a prefix that is no worse: as
    costs follow from audits, no prefix of a node is part of another one with its cost, so the lesser (cost, audit)
    stays the lesser whatever follows. The stack is empty when optimality is proved. Edits are tried in ASCII order, so
    a node is entered again only at a smaller cost: at most (turns + 1) * 4 * (greedy cost - bound + 1) entries.

    Only user and assistant need a search: none is left by deleting everything, and system is reached by keeping one
    system turn at most.
    """
    n = len(turns)
    bound = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        bound[i] = bound[i + 1] + _least(turns[i])
    best: dict[int, tuple[int, str]] = {}
    if entry in (NONE, SYSTEM):
        best[entry] = (DELETE * n, "D" * n)
    if entry == NONE:
        kept = [(DELETE * (n - 1) + (TRUNCATED if t.truncated else 0), "D" * i + "K" + "D" * (n - 1 - i)) for i, t in enumerate(turns) if t.initial == "s" and not t.must_go]
        if kept:
            best[SYSTEM] = min(kept)
    incumbent = {end: _greedy(turns, entry, end) for end in (USER, ASSISTANT)}
    dominance: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, entry, 0, "")]
    while stack:
        i, state, cost, audit = stack.pop()
        seen = dominance.get((i, state))
        if seen is not None and seen <= (cost, audit):
            continue
        dominance[i, state] = (cost, audit)
        if i == n and state in incumbent and (cost, audit) < incumbent[state]:
            incumbent[state] = (cost, audit)
        reach = (cost + bound[i], audit)
        if all(reach > found for found in incumbent.values()):
            continue
        for edit, price, after, used in reversed(list(_edits(turns[i] if i < n else None, state))):
            child = (cost + price, audit + edit)
            known = dominance.get((i + used, after))
            if (known is None or child < known) and any((child[0] + bound[i + used], child[1]) <= found for found in incumbent.values()):
                stack.append((i + used, after, *child))
    return best | incumbent


def repair(turns: list[Turn]) -> tuple[int, str]:
    """The cheapest (cost, audit) for a whole conversation that is one segment."""
    found = search(turns, NONE)
    return min(found[end] for end in LEGAL_END if end in found)


class _Path:
    """The best audits of the segments so far, per state at the end; what all of them share is held once."""

    def __init__(self):
        self.shared: list[str] = []
        self.best: dict[int, tuple[int, str]] = {NONE: (0, "")}

    def extend(self, found: dict[int, dict[int, tuple[int, str]]]) -> None:
        """`found`: entry -> end -> (cost, audit) of the next segment."""
        after: dict[int, tuple[int, str]] = {}
        for entry, (cost, audit) in self.best.items():
            for end, (more, edits) in found[entry].items():
                option = (cost + more, audit + edits)
                if end not in after or option < after[end]:
                    after[end] = option
        common = os.path.commonprefix([audit for _, audit in after.values()])
        self.shared.append(common)
        self.best = {end: (cost, audit[len(common) :]) for end, (cost, audit) in after.items()}

    def close(self) -> tuple[int, str]:
        cost, audit = min(self.best[end] for end in LEGAL_END if end in self.best)
        return cost, "".join(self.shared) + audit


def damaged(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """_key, _turn, _role, _text, _copies: every row after its damage, which crc32 of key:turn decides; _copies is 0 for a dropped one.

    In that key nulls are one space, and so are null roles and texts.
    """
    space = F.lit(" ")
    named = F.concat(F.coalesce(df[key].cast("string"), space), F.lit(":"), F.coalesce(df[turn].cast("string"), space))
    rows = df.select(df[key].alias("_key"), df[turn].alias("_turn"), F.coalesce(df[role], space).alias("_role"), F.coalesce(df[text], space).alias("_text"), (F.crc32(named.cast("binary")) % 20).alias("_hit"))
    return rows.select(
        "_key",
        "_turn",
        F.when(F.col("_hit") == 4, "user").otherwise(F.col("_role")).alias("_role"),
        F.when(F.col("_hit").isin(0, 1), "").when(F.col("_hit") == 2, F.translate("_text", ENDS, "")).otherwise(F.col("_text")).alias("_text"),
        F.when(F.col("_hit") == 0, 0).when(F.col("_hit") == 3, 2).otherwise(1).alias("_copies"),
    )


def whole(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows as `repair_conversations` wants them, without damage; null roles and texts are one space."""
    return df.select(df[key].alias("_key"), df[turn].alias("_turn"), F.coalesce(df[role], F.lit(" ")).alias("_role"), F.coalesce(df[text], F.lit(" ")).alias("_text"), F.lit(1).alias("_copies"))


def _earliest(turn: Column) -> Column:
    """An order of turns in which nulls come first."""
    return F.struct(turn.isNotNull().alias("known"), turn.alias("turn"))


_MOVE = pa.struct([("entry", pa.int8()), ("end", pa.int8()), ("cost", pa.int64()), ("audit", pa.string())])
_SEGMENT = [("_chunk", pa.int64()), ("_nr", pa.int64()), ("_kind", pa.int8()), ("_moves", pa.list_(_MOVE)), ("_turns", pa.list_(pa.int64())), ("_roles", pa.list_(pa.string())), ("_texts", pa.list_(pa.string())), ("_faults", pa.string())]
_SEGMENT_DDL = "_chunk long, _nr long, _kind byte, _moves array<struct<entry:byte,end:byte,cost:bigint,audit:string>>, _turns array<bigint>, _roles array<string>, _texts array<string>, _faults string"


def segments(rows: DataFrame) -> DataFrame:
    """Per segment of at most SEGMENT turns of a conversation two rows: kind 0 with the best edits between all states, kind 1 with its turns.

    A conversation is cut by its turn numbers into chunks, which are searched in different tasks, and within a task into
    segments as its sorted rows stream by. The earliest turn with a role and text is found by an aggregate, so that no
    task keeps a conversation's texts; rows with that turn are neighbours in the stream, and all but one of them repeat.
    """
    digest = F.unhex(F.sha2("_text", 256))
    rows = rows.withColumn("_turn", F.col("_turn").cast("long"))
    light = rows.where("_copies > 0").select("_key", "_role", digest.alias("_digest"), "_turn")
    first = light.groupBy(F.col("_key").alias("_k"), F.col("_role").alias("_r"), F.col("_digest").alias("_d")).agg(F.min(_earliest(F.col("_turn"))).alias("_first"))
    known = rows.withColumn("_digest", digest)
    joined = known.join(first, known["_key"].eqNullSafe(F.col("_k")) & (known["_role"] == F.col("_r")) & (known["_digest"] == F.col("_d")), "left")
    last = F.right(F.rtrim(F.col("_text"), F.lit(WHITES)), F.lit(1))
    marked = joined.select(
        "_key",
        F.coalesce(F.floor(F.col("_turn") / F.lit(CHUNK)).cast("long"), F.lit(-(1 << 62))).alias("_chunk"),
        "_turn",
        "_role",
        "_text",
        "_copies",
        F.when(last == "", "B").when(_earliest(F.col("_turn")) > F.col("_first"), "D").when(~last.isin(*ENDS), "T").otherwise("-").alias("_fault"),
    )
    dealt = marked.repartition("_key", "_chunk").sortWithinPartitions("_key", "_chunk", "_turn", "_role", "_text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, size, nr, before, out = None, [], 0, 0, None, []

        def close() -> None:
            turns = [Turn(r[:1], f in "BD", f == "T") for _, r, _, f in held]
            moves = [{"entry": e, "end": s, "cost": c, "audit": a} for e in range(4) for s, (c, a) in search(turns, e).items()]
            out.append((place[0], place[1], nr, 0, moves, [], [], [], ""))
            out.append((place[0], place[1], nr, 1, [], *([x[k] for x in held] for k in range(3)), "".join(x[3] for x in held)))

        def told(keys: pa.DataType) -> pa.RecordBatch:
            kinds = [keys, *(kind for _, kind in _SEGMENT)]
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)], ["_key", *(n for n, _ in _SEGMENT)])

        keys = None
        for part in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            keys = part["_key"].type
            for key, chunk, turn, role, text, copies, fault in zip(*(part[c].to_pylist() for c in ("_key", "_chunk", "_turn", "_role", "_text", "_copies", "_fault")), strict=True):
                if place is None or (key, chunk) != place:
                    if place is not None:
                        close()
                    place, held, size, nr, before = (key, chunk), [], 0, 0, None
                for _ in range(copies):
                    if len(held) == SEGMENT or size > SEGMENT_CHARS:
                        close()
                        held, size, nr = [], 0, nr + 1
                    same = before == (turn, role, text)
                    held.append((turn, role, text, "D" if same and fault != "B" else fault))
                    before, size = (turn, role, text), size + len(text)
            if out:
                yield told(keys)
                out.clear()
        if place is not None:
            close()
            yield told(keys)

    kind = dict(rows.dtypes)["_key"]
    return dealt.mapInArrow(cut, f"_key {kind}, {_SEGMENT_DDL}")


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repair_conversations(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """key, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256: one row per conversation.

    `rows` are those of `damaged` or `whole`. A conversation's turns are taken by number, nulls first, equal numbers by
    role and text. A turn's first fault counts: blank (nothing but white space), duplicate (its role and text were seen
    earlier), truncated (the last other character is no end of a sentence). Edits cost as follows: keep 0, rename to
    user or assistant 3, delete 4 (which blank and duplicate turns must be), insert an empty user or assistant turn 3,
    and 3 more for a truncated turn that stays. audit has the initials of the cheapest edits that give the initials
    s?(ua)+ or nothing, of equally cheap ones the ASCII-least; a role that begins with none of s, u, a (an empty one too)
    can't be kept. A conversation without turns is legal; it has zeros and the hash of an empty text.

    The best edits of the segments are joined in order, then the turns stream by once and are edited and hashed, so that a
    task holds one segment and an audit, never a conversation's texts. Empty tables give no rows; other columns of the
    source are ignored.
    """
    parts = segments(rows).repartition("_key").sortWithinPartitions("_key", "_kind", "_chunk", "_nr")
    kinds = [*((c, pa.int64()) for c in _COUNTS), ("audit", pa.string()), ("repaired_sha256", pa.string())]

    def told(states: list, keys: pa.DataType) -> pa.RecordBatch:
        columns = [pa.array(c, kind) for c, (_, kind) in zip(zip(*(s.row() for s in states), strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([s.key for s in states], keys), *columns], ["_key", *(n for n, _ in kinds)])

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            done, keys = [], batch["_key"].type
            for part in (batch.slice(i, SLICE) for i in range(0, batch.num_rows, SLICE)):
                for key, segment, moves, turns, roles, texts, faults in zip(*(part[c].to_pylist() for c in ("_key", "_kind", "_moves", "_turns", "_roles", "_texts", "_faults")), strict=True):
                    if state is None or state.key != key:
                        done += [state] if state else []
                        state = _Edited(key)
                    if segment == 0:
                        state.weigh(moves)
                    else:
                        state.edit(turns, roles, texts, faults)
            if done:
                yield told(done, keys)
        if state:
            yield told([state], keys)

    kind = dict(rows.dtypes)["_key"]
    out = parts.mapInArrow(edit, f"_key {kind}, {', '.join(f'{c} long' for c in _COUNTS)}, audit string, repaired_sha256 string")
    return out.withColumnRenamed("_key", key)


class _Edited:
    """A conversation as it streams by: first the moves of all its segments, then its turns."""

    def __init__(self, key):
        self.key, self.path, self.audit, self.at, self.state = key, _Path(), None, 0, NONE
        self.cost = self.distinct = self.illegal = 0
        self.faults = dict.fromkeys("BDT", 0)
        self.span, self.last_turn, self.last_initial = None, None, None
        self.hash, self.begun = hashlib.sha256(), False

    def weigh(self, moves: list[dict]) -> None:
        found: dict[int, dict[int, tuple[int, str]]] = {entry: {} for entry in range(4)}
        for m in moves:
            found[m["entry"]][m["end"]] = (m["cost"], m["audit"])
        self.path.extend(found)

    def _settle(self) -> None:
        if self.audit is None:
            self.cost, self.audit = self.path.close()

    def _say(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.begun else "") + f"{role}:{text}").encode("utf-8"))
        self.begun = True

    def _insert(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            role, self.state = NEXT_ROLE[self.state]
            self._say(role, "")
            self.at += 1

    def edit(self, turns: list, roles: list[str], texts: list[str], faults: str) -> None:
        self._settle()
        for turn, role, text, fault in zip(turns, roles, texts, faults, strict=True):
            if fault in self.faults:
                self.faults[fault] += 1
            if turn is not None:
                self.distinct += self.last_turn is None or turn != self.last_turn
                self.span, self.last_turn = (turn if self.span is None else self.span[0], turn), turn
            initial = role[:1]
            self.illegal += self.last_initial is not None and self.last_initial + initial not in ("su", "ua", "au")
            self.last_initial = initial
            self._insert()
            edit = self.audit[self.at]
            self.at += 1
            if edit == "K":
                self.state = FOLLOWS[self.state, initial]
                self._say(role, text)
            elif edit == "R":
                role, self.state = NEXT_ROLE[self.state]
                self._say(role, text)

    def row(self) -> tuple:
        self._settle()
        self._insert()
        gaps = 0 if self.span is None else self.span[1] - self.span[0] + 1 - self.distinct
        return gaps, self.faults["B"], self.faults["D"], self.faults["T"], self.illegal, self.cost, self.audit, self.hash.hexdigest()
