"""Byte-level BPE: texts to ids and back, by a rank file.

Texts are parted without regular expressions. Every code point has a class (letter, number, white
space, other; apostrophes and white space are told apart by what follows), and a class is a function
from the state of the token being read to the next state. These functions are closed under
composition, a monoid of a few dozen elements whose product is a lookup, so the state before every
code point comes from an associative scan: blocks are composed side by side, then the block totals,
then each block is applied to the state it begins with. A token begins where state and class say so.

Each distinct slice is merged once, its pair of the lowest rank first, and kept in a bounded cache.
Ids stay with the byte offsets where their tokens begin, so any run of tokens can be decoded.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame

from stratamart.llm import text as T

CACHED_SLICES = 700_000
SLICE_BYTES = 1 << 19  # texts are encoded in runs of about this size
BLOCK = 128

LETTER, NUMBER, OTHER, SPACE = range(4)  # classes of code points
# what a code point does: apostrophes that begin an ending of one or two letters, the last white
# space before other characters (a blank joins them), white space with more after it or at the end
S_LETTER, S_NUMBER, S_OTHER, S_END1, S_END2, S_BLANK, S_LAST, S_MORE = range(8)
START, LETTERS, NUMBERS, OTHERS, WHITE, BLANK, NEED1, NEED2 = range(8)  # states: the token so far


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a token begins at the symbol."""
    if symbol == S_LETTER:
        if state in (NEED1, NEED2):
            return (START if state == NEED1 else NEED1), False
        return LETTERS, state not in (LETTERS, BLANK)
    if symbol == S_NUMBER:
        return NUMBERS, state not in (NUMBERS, BLANK)
    if symbol in (S_OTHER, S_END1, S_END2):
        if symbol == S_OTHER or state in (OTHERS, BLANK):
            return OTHERS, state not in (OTHERS, BLANK)
        return (NEED1 if symbol == S_END1 else NEED2), True
    if symbol == S_MORE:
        return WHITE, state != WHITE
    return (BLANK if symbol == S_BLANK else START), True


class Transitions:
    """The functions of the symbols, and of symbols at the start of a text (numbered from 8 on),
    closed under composition."""

    def __init__(self) -> None:
        single = [tuple(_step(state, symbol)[0] for state in range(8)) for symbol in range(8)]
        single += [(f[START],) * 8 for f in single]
        found = {tuple(range(8)): 0}
        for f in single:
            found.setdefault(f, len(found))
        known = 0
        while known < len(found):
            for f in list(found)[known:]:
                known += 1
                for g in single:
                    found.setdefault(tuple(g[s] for s in f), len(found))
        functions = list(found)
        self.size = len(functions)
        self.of_symbol = np.array([found[f] for f in single], np.uint16)
        self.then = np.array([[found[tuple(g[s] for s in f)] for g in functions] for f in functions], np.uint16).ravel()
        self.act = np.array(functions, np.uint8)
        self.begins = np.array([[_step(state, symbol)[1] for symbol in range(8)] for state in range(8)]).ravel()

    def states(self, symbols: np.ndarray) -> np.ndarray:
        """The state after each symbol (0 to 15) of a run that begins in START."""
        return self._scan(self.of_symbol[symbols])

    def _scan(self, functions: np.ndarray) -> np.ndarray:
        n = len(functions)
        blocks = -(-n // BLOCK)
        held = np.zeros(blocks * BLOCK, np.uint16)  # 0 is the identity
        held[:n] = functions
        held = np.ascontiguousarray(held.reshape(blocks, BLOCK).T)
        for k in range(1, BLOCK):
            held[k] = self.then[held[k - 1].astype(np.int32) * self.size + held[k]]
        begin = np.zeros(blocks, np.uint8)
        if blocks > 1:
            begin[1:] = self._scan(held[-1][:-1])
        return np.ascontiguousarray(self.act[held, begin].T).ravel()[:n]


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of UTF-8 bytes, and where each begins."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    if len(at) == len(data):
        return data.astype(np.int32), at
    points = data[at].astype(np.int32)
    padded = np.append(data, np.zeros(3, np.uint8))
    for low, high, mask, more in ((0xC0, 0xE0, 0x1F, 1), (0xE0, 0xF0, 0x0F, 2), (0xF0, 0x100, 0x07, 3)):
        some = np.flatnonzero((points >= low) & (points < high)) if more == 1 else rest[(lead >= low) & (lead < high)]
        if more == 1:
            rest = np.flatnonzero(points >= 0xE0)
            lead = points[rest]
        value = points[some] & mask
        for k in range(1, more + 1):
            value = (value << 6) | (padded[at[some] + k] & 0x3F)
        points[some] = value
    return points, at


def _classes() -> np.ndarray:
    """The class of every code point, as the merging library's own Unicode tables have it."""
    import tiktoken

    out = np.full(1 << 21, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        single = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        for low in range(0, 0x110000, 0x4000):
            every = "".join(map(chr, (c for c in range(low, low + 0x4000) if not 0xD800 <= c < 0xE000)))
            of_kind = single.decode_bytes(single.encode_ordinary(every)).decode().encode("utf-32-le")
            out[np.frombuffer(of_kind, "<u4")] = kind
    return out


class Vocabulary:
    """The tokens of a rank file (``token in base64, rank`` a line) as one array of bytes."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.lengths = np.zeros(max(self.ranks.values()) + 1, np.int64)
        for token, rank in self.ranks.items():
            self.lengths[rank] = len(token)
        self.token_end = np.cumsum(self.lengths)
        self.token_begin = self.token_end - self.lengths
        self.vocabulary = np.zeros(int(self.lengths.sum()), np.uint8)
        for token, rank in self.ranks.items():
            self.vocabulary[self.token_begin[rank]:self.token_end[rank]] = np.frombuffer(token, np.uint8)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids, each looked up in one array of the vocabulary's bytes."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self.vocabulary[np.repeat(self.token_begin[ids] - ends + lengths, lengths) + np.arange(total)]


class ByteBpe(Vocabulary):
    """Ids of texts by the ranks of a file."""

    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.bytes = [self.ranks[bytes([b])] for b in range(256)]
        self.pairs: dict[int, int] = {}  # both ids in one number, which takes less memory than a pair
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                left, right = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if left is not None and right is not None:
                    self.pairs[left << 32 | right] = rank
        self.classes = _classes()
        self.transitions = Transitions()
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # hashes of slices, sorted; what follows is in their order
        self.begin = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def slices(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each token slice of the texts begins, in order, and each text's first slice (one
        more at the end)."""
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        points, at = code_points(data)
        kind = self.classes[points]
        n = len(points)
        first = np.zeros(n + 1, bool)  # the first code point of a text
        first[np.searchsorted(at, offsets)] = True
        symbol = kind.copy()  # letters, numbers and others are symbols of the same number
        space = np.flatnonzero(kind == SPACE)
        if len(space):
            ends = ~first[space + 1] & (kind[np.minimum(space + 1, n - 1)] != SPACE)
            symbol[space] = np.where(ends, np.where(points[space] == 32, S_BLANK, S_LAST), S_MORE)
        mark = np.flatnonzero(points == ord("'"))
        mark = mark[(mark + 1 < n)]
        mark = mark[~first[mark + 1]]
        if len(mark):
            one = points[mark + 1]
            two = np.where((mark + 2 < n) & ~first[np.minimum(mark + 2, n)], points[np.minimum(mark + 2, n - 1)], 0)
            symbol[mark[np.isin(one, [ord(c) for c in "stmd"])]] = S_END1
            for ending in ("re", "ve", "ll"):
                symbol[mark[(one == ord(ending[0])) & (two == ord(ending[1]))]] = S_END2
        state = self.transitions.states(symbol + np.where(first[:n], np.uint8(8), np.uint8(0)))
        before = np.zeros(n, np.uint8)
        before[1:] = state[:-1]
        begins = self.transitions.begins[before * np.uint8(8) + symbol] | first[:n]
        starts = at[begins]
        return starts, np.searchsorted(starts, offsets)

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one slice: the pair of the lowest rank, the leftmost of equals, is joined first."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        ids = [self.bytes[b] for b in piece]
        if len(ids) > 64:
            return self._merge_long(ids)
        pairs = self.pairs
        found = [pairs.get(a << 32 | b, 1 << 30) for a, b in zip(ids, ids[1:], strict=False)]
        while found:
            least = min(found)
            if least == 1 << 30:
                break
            k = found.index(least)
            ids[k:k + 2] = [least]
            del found[k]
            if k < len(found):
                found[k] = pairs.get(least << 32 | ids[k + 1], 1 << 30)
            if k:
                found[k - 1] = pairs.get(ids[k - 1] << 32 | least, 1 << 30)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank, k, a, b) for k, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if (rank := self.pairs.get(a << 32 | b)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, k, a, b = heapq.heappop(heap)
            right = after[k]
            if ids[k] != a or right >= n or ids[right] != b:
                continue  # one of the two has been joined with another
            ids[k], ids[right] = rank, -1
            after[k] = after[right]
            if after[k] < n:
                before[after[k]] = k
                if (joined := self.pairs.get(rank << 32 | ids[after[k]])) is not None:
                    heapq.heappush(heap, (joined, k, rank, ids[after[k]]))
            if before[k] >= 0 and (joined := self.pairs.get(ids[before[k]] << 32 | rank)) is not None:
                heapq.heappush(heap, (joined, before[k], ids[before[k]], rank))
        return [i for i in ids if i >= 0]

    def _learn(self, keys: np.ndarray, merged: list[list[int]]) -> None:
        """Keep the ids of new slices, whose sorted hashes are ``keys``."""
        count = np.array([len(ids) for ids in merged], np.int64)
        total = int(count.sum())
        if self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), total), np.uint32)])
        self.ids[self.used:self.used + total] = np.fromiter((i for ids in merged for i in ids), np.uint32, total)
        at = np.searchsorted(self.keys, keys)
        self.begin = np.insert(self.begin, at, self.used + np.cumsum(count) - count)
        self.count = np.insert(self.count, at, count)
        self.keys = np.insert(self.keys, at, keys)
        self.used += total

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of the texts, the byte where each id's token begins in its text, and the bounds of
        each text in them."""
        if len(data) > 2 * SLICE_BYTES and len(offsets) == 2:
            return self._encode_long(data)
        starts, first = self.slices(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64), first
        ends = np.append(starts[1:], len(data))
        hashes = T.span_hash(T.prefix_hash(data), starts, ends)
        distinct, where, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) + len(distinct) > CACHED_SLICES or self.used > 8 * CACHED_SLICES:
            self._clear()
        place = np.searchsorted(self.keys, distinct)
        new = place == len(self.keys)
        new[~new] = self.keys[place[~new]] != distinct[~new]
        if new.any():
            raw = data.tobytes()
            self._learn(distinct[new], [self.merge(raw[s:e]) for s, e in zip(starts[where[new]].tolist(), ends[where[new]].tolist(), strict=True)])
        at = np.searchsorted(self.keys, distinct)[which]
        counts = self.count[at]
        bounds = np.zeros(len(at) + 1, np.int64)
        np.cumsum(counts, out=bounds[1:])
        ids = self.ids[np.repeat(self.begin[at] - bounds[:-1], counts) + np.arange(bounds[-1])]
        bounds = bounds[first]
        ends = np.cumsum(self.lengths[ids])
        return ids, ends - self.lengths[ids] - np.repeat(offsets[:-1], np.diff(bounds)), bounds

    def _encode_long(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A long text, in parts that begin at a white space after another character: a token begins
        there whatever else the text holds."""
        ids, begins, at = [], [], 0
        while at < len(data):
            stop = min(at + SLICE_BYTES, len(data))
            white = T.IS_SPACE[data[at:]] if stop == len(data) else T.IS_SPACE[data[at:stop + SLICE_BYTES]]
            cuts = np.flatnonzero(white[1:] & ~white[:-1] & ((data[at:at + len(white) - 1] < 0x80))) + 1 + at
            cut = cuts[cuts >= stop][:1] if stop < len(data) else cuts[:0]
            if stop < len(data) and not len(cut):  # no such place nearby: the rest is one part
                rest = T.IS_SPACE[data[stop:]]
                cut = np.flatnonzero(rest[1:] & ~rest[:-1] & (data[stop:-1] < 0x80))[:1] + 1 + stop
            stop = int(cut[0]) if len(cut) else len(data)
            part = data[at:stop]
            starts = np.array([0, len(part)])
            if len(part) > 2 * SLICE_BYTES:
                starts = np.array([0, len(part), len(part)])  # an empty text after it: not parted again
            found, places, bounds = self.encode(part, starts)
            ids.append(found)
            begins.append(places + at)
            at = stop
        return np.concatenate(ids), np.concatenate(begins), np.array([0, sum(map(len, ids))])


_held: dict[tuple[type, str], Vocabulary] = {}


def _of(kind: type, path: str) -> Vocabulary:
    if (kind, path) not in _held:
        _held[kind, path] = kind(path)
    return _held[kind, path]


def encode(docs: DataFrame, ranks: str) -> DataFrame:
    """``(doc_id, ids, offsets)`` of every row of ``docs(doc_id, text)``: the ids as little-endian
    unsigned 32-bit integers, and as many 64-bit byte offsets where their tokens begin in the text.

    Special tokens are ordinary text. A null or empty text has no ids. Repeated rows and rows without
    a ``doc_id`` are rows like others; other columns are not read. Long texts are parted in pieces, so
    memory is bounded by the text and its ids. ``ranks`` is a path that every worker can open.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _of(ByteBpe, ranks)
        for batch in batches:
            for row, stop, data, offsets in T.slices(batch.column(1), SLICE_BYTES):
                ids, begins, bounds = bpe.encode(data, offsets)
                raw, places = ids.astype("<u4", copy=False), begins.astype("<i8", copy=False)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, stop - row), *(
                    pa.Array.from_buffers(pa.large_binary(), stop - row, [None, pa.py_buffer((bounds * x.itemsize).tobytes()), pa.py_buffer(x)]).cast(pa.binary())
                    for x in (raw, places))], ["doc_id", "ids", "offsets"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids binary, offsets binary")


def decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """``encoded`` with ``decoded``, the bytes of its ``ids``; null ids give null. An id that the file
    does not have is refused."""
    names = encoded.columns
    place = names.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _of(Vocabulary, ranks)
        for batch in batches:
            for row in range(0, batch.num_rows, 256):
                part = batch.slice(row, 256)
                column = part.column(place).cast(pa.large_binary())
                _, bounds, data = column.buffers()
                bounds = np.frombuffer(bounds, np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
                ids = np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]].copy().view("<u4") if data is not None else np.zeros(0, np.uint32)
                if len(ids) and (int(ids.max()) >= len(bpe.lengths) or not bpe.lengths[ids].all()):
                    raise ValueError("an id is not of this vocabulary")
                ends = np.zeros(len(ids) + 1, np.int64)
                np.cumsum(bpe.lengths[ids], out=ends[1:])
                out = pa.Array.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer(ends[(bounds - bounds[0]) // 4]), pa.py_buffer(bpe.decode(ids))])
                out = pa.compute.if_else(part.column(place).is_valid(), out.cast(pa.binary()), pa.scalar(None, pa.binary()))
                yield pa.RecordBatch.from_arrays([*part.columns, out], [*names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{fields}, decoded binary")
