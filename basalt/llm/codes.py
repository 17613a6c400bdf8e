"""Texts as arrays of folded code points, a batch at a time."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from .common import text_buffers


@lru_cache(maxsize=1)
def fold_table() -> np.ndarray:
    """For each code point: its lower case if it is a letter, itself if a mark or digit, else 0."""
    out = np.zeros(0x110000, np.uint32)
    for cp in range(0x30000):
        c = chr(cp)
        if c.isalpha():
            low = c.lower()
            out[cp] = ord(low) if len(low) == 1 else cp
        elif c.isalnum() or "̀" <= c <= "ͯ":
            out[cp] = cp
    return out


#: Bytes of a text that are in work at a time.
PIECE = 1 << 20


@dataclass(frozen=True)
class Pieces:
    """Cuts of texts: the text of each, folded code points with a 0 after each cut, offsets, and how many are its own.

    What follows a cut's own points is from the next cut of the same text, for those who look ahead.
    """

    rows: np.ndarray
    points: np.ndarray
    offsets: np.ndarray
    own: np.ndarray


def folded_pieces(column, ahead: int = 2):
    """The texts of an Arrow string column in order, about PIECE bytes at a time; a text may go over several cuts.

    Only the last cut of a text counts the 0 after it as its own.
    """
    data, offsets = text_buffers(column)
    begins = lambda at: data[at] & 0xC0 != 0x80
    held: list[tuple[int, bytes, int]] = []
    gathered = 0

    def flush():
        points = np.frombuffer(b"".join(x for _, raw, _ in held for x in (raw, b"\0\0\0\0")), np.uint32)
        sizes = np.array([len(raw) // 4 + 1 for _, raw, _ in held])
        rows, own = (np.array([h[k] for h in held]) for k in (0, 2))
        return Pieces(rows, fold_table()[points], np.concatenate([[0], np.cumsum(sizes)]), own)

    for r, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        at, done = a, False
        while not done:
            to = min(b, at + PIECE)
            while to < b and not begins(to):
                to += 1
            end, done = to, to == b
            for _ in range(ahead):
                end = min(b, end + 1)
                while end < b and not begins(end):
                    end += 1
            raw = data[at:end].tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass")
            own = len(raw) // 4 + 1 if done else int(np.count_nonzero(data[at:to] & 0xC0 != 0x80))
            held.append((r, raw, own))
            gathered += to - at
            at = to
            if gathered >= PIECE:
                yield flush()
                held, gathered = [], 0
    if held:
        yield flush()


def sum_by(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Row sums between offsets; 0 for an empty stretch."""
    out = np.zeros((len(offsets) - 1, *values.shape[1:]), np.float64)
    full = np.flatnonzero(np.diff(offsets) > 0)
    if len(full):
        out[full] = np.add.reduceat(values, offsets[full], axis=0, dtype=np.float64)
    return out


def by_bytes(batches, most: int = 2 << 20, column: int = 1):
    """Arrow batches cut so that a slice's texts, in one column, have about so many bytes."""
    for batch in batches:
        _, offsets = text_buffers(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + most, "right"))
            to = min(max(at + 1, to), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to
