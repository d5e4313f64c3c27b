"""Words, lines and hashes of whole texts, as numpy over Arrow buffers.

A word is a run of bytes other than space and U+0009 to U+000D; these are single bytes in
UTF-8 and never part of another character, so byte-wise and character-wise words agree.
Hashes are 64 bits: polynomial over the bytes modulo 2^64, then mixed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
RUN_BYTES = 512 << 10  # of text at once where all its words are hashed: their arrays stay small

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_U64 = (1 << 64) - 1
POWERS_STEP = 1 << 18  # the tables stay in a worker, so they grow with what is asked
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse modulo 2^64."""
    if len(_powers[0]) < n:
        size = -(-n // POWERS_STEP) * POWERS_STEP
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            table = np.empty(size, np.uint64)
            table[0] = 1
            done = 1
            while done < size:
                step = min(done, size - done)
                table[done:done + step] = table[:step] * np.uint64(pow(base, done, 1 << 64))
                done += step
            _powers[k] = table
    return _powers[0][:n], _powers[1][:n]


_kept: dict[object, object] = {}


def kept(owner: object, make: Callable[[], object] | None = None) -> object:
    """What ``owner`` keeps in a worker between tasks, made when first asked for. Spark gives a worker
    to one operator after the other, so what another has kept there goes; without ``make`` all of it."""
    for other in [k for k in _kept if k != owner]:
        del _kept[other]
    if make is None:
        return None
    if owner not in _kept:
        _kept[owner] = make()
    return _kept[owner]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, past the last row, bytes, offsets)`` for runs of rows of about ``limit``
    bytes; a longer text is a run of its own, whole. A null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, stop, whole[offsets[row]:offsets[stop]], offsets[row:stop + 1] - offsets[row]
        row = stop


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; other bytes stay."""
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """``P`` with ``(P[e] - P[s]) * inverse_power[s]`` the polynomial hash of ``data[s:e]``."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data))[0], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    inverse = powers(len(prefix))[1]
    return mix((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the index of each text's first word (one more at the end)."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    space = IS_SPACE[data]
    edge = np.ones(n + 1, bool)  # a border before byte i: after a space or where a text begins
    edge[1:n] = space[:-1]
    edge[offsets] = True
    starts = np.flatnonzero(edge[:n] & ~space)
    edge = np.ones(n + 1, bool)
    edge[:n] = space
    edge[offsets] = True
    ends = np.flatnonzero(edge[1:] & ~space) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def windows(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``size`` words that lie in one text, and each text's first
    window (one more at the end). A text of fewer words has none."""
    counts = np.maximum(np.diff(first) - size + 1, 0)
    bounds = np.zeros(len(first), np.int64)
    np.cumsum(counts, out=bounds[1:])
    if not bounds[-1]:
        return np.zeros(0, np.uint64), bounds
    length = len(words) - size + 1
    total = np.zeros(length, np.uint64)
    for k in range(size):
        total += words[k:k + length] * np.uint64(pow(_BASE, 2 * k + 1, 1 << 64))
    keep = np.zeros(length + 1, np.int64)
    some = counts > 0
    np.add.at(keep, first[:-1][some], 1)
    np.add.at(keep, first[:-1][some] + counts[some], -1)
    return mix(total[np.cumsum(keep[:-1]) > 0]), bounds


def text_of_columns(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
