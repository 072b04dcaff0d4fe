"""Words of Arrow text columns as 64-bit hashes, worked out on whole byte blocks without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from incidence.llm.common import splitmix

_RNG = np.random.default_rng(20240229)
#: A random 64-bit value per byte, and an odd factor per place in a word.
_VALUE = _RNG.integers(0, 1 << 64, 256, dtype=np.uint64)
_FACTOR = np.uint64(0xD1342543DE82EF95)

#: Separators: space and tab to carriage return.
WHITE = np.zeros(256, bool)
WHITE[[32, *range(9, 14)]] = True
#: Separators: every ASCII character but letters and digits.
PUNCTUATION = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
NEWLINE = 10


def _lowered(values: np.ndarray) -> np.ndarray:
    out = values.copy()
    out[65:91] = values[97:123]
    return out


def span_hashes(blob: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = _VALUE) -> np.ndarray:
    """The hash of each span starts .. ends (its last byte): equal bytes, equal hashes."""
    # A span's polynomial: the sum over its bytes of value * factor^place, moved to place 0.
    _POWERS.reach(len(blob))
    sums = np.cumsum(values[blob] * _POWERS.up[: len(blob)], dtype=np.uint64)
    before = np.where(starts > 0, sums[starts - 1], np.uint64(0)) if len(starts) else sums[:0]
    return splitmix((sums[ends] - before) * _POWERS.down[starts])


@dataclass
class Block:
    """Texts first .. first + len(bounds) - 2 of a column: word hashes, and where each text's words start."""

    first: int
    hashes: np.ndarray
    bounds: np.ndarray
    line: np.ndarray | None  # of each word: number of newlines before it in its text
    lines: np.ndarray | None  # of each text: number of newlines
    blob: np.ndarray  # the texts' bytes
    cuts: np.ndarray  # where each text's bytes start
    starts: np.ndarray  # of each word: its first byte


class _Powers:
    """FACTOR^0, FACTOR^1, ... modulo 2^64 and their inverses, as far as they were needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            factors = (int(_FACTOR), pow(int(_FACTOR), -1, 1 << 64))
            self.up, self.down = (np.cumprod(np.r_[np.uint64(1), np.full(n - 1, f, np.uint64)], dtype=np.uint64) for f in factors)


_POWERS = _Powers()


def blocks(texts: pa.Array | pa.ChunkedArray, separators: np.ndarray = WHITE, lower: bool = False, with_lines: bool = False, limit: int = 1 << 17) -> Iterator[Block]:
    """Blocks of about `limit` bytes (a longer text is one block); null texts must have been filled.

    Words are runs of bytes that are no separators (separators are ASCII, so UTF-8 characters stay whole); equal words
    have equal hashes, and different ones differ but for chance of 2^-64 or so. `lower` takes A-Z as a-z.
    """
    values = _lowered(_VALUE) if lower else _VALUE
    for chunk in texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts]:
        column = chunk.cast(pa.large_string())
        _, offsets, data = column.buffers()
        ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        bytes_ = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        at = 0
        while at < len(column):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, side="right")) - 1)
            yield _block(at, bytes_[ends[at] : ends[to]], ends[at : to + 1] - ends[at], separators, values, with_lines)
            at = to


def _block(first: int, blob: np.ndarray, cuts: np.ndarray, separators: np.ndarray, values: np.ndarray, with_lines: bool) -> Block:
    inside = ~separators[blob]
    starts_flag = inside.copy()
    starts_flag[1:] &= ~inside[:-1]
    heads = cuts[:-1][cuts[:-1] < len(blob)]
    starts_flag[heads] = inside[heads]  # a text starts a word of its own
    ends_flag = inside.copy()
    ends_flag[:-1] &= starts_flag[1:] | ~inside[1:]
    starts, ends = np.flatnonzero(starts_flag), np.flatnonzero(ends_flag)
    hashes = span_hashes(blob, starts, ends, values)
    line = lines = None
    if with_lines:
        count = np.r_[0, np.cumsum(blob == NEWLINE)]
        bounds = np.searchsorted(starts, cuts)
        lines = count[cuts[1:]] - count[cuts[:-1]]
        line = count[starts] - np.repeat(count[cuts[:-1]], np.diff(bounds))
    return Block(first, hashes, np.searchsorted(starts, cuts), line, lines, blob, cuts, starts)
