"""Best-fit packing: length patterns fitted by non-negative least squares.

The histogram of piece lengths has at most ``capacity`` entries at any table size, so the plan is
made from it alone: patterns of up to three length classes that fill a sequence are enumerated,
their repeat counts fitted to the histogram by non-negative least squares and rounded down, and
the pieces left over are put by best fit, longest first, into what the patterns leave open and
into new sequences. All of this works on runs of equal sequences, never on single pieces.

Pieces are then numbered within their length, in ranges, and look their place up in the plan.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratamart.llm import text as T
from stratamart.session import stable

CAPACITY, END_ID = 4096, 1
CLASS_WIDTH = 8
RANGE_ROWS = 20_000
CACHED_WORDS = 700_000


_LATIN_LEAD, _LATIN_LETTER = 0xC3, np.zeros(256, bool)  # U+00C0 to U+00FF but the signs of times and division
_LATIN_LETTER[0x80:0xC0] = True
_LATIN_LETTER[[0x97, 0xB7]] = False
_MARKS = np.zeros(256, bool)  # not the apostrophe, which the vocabulary joins with some letters
_MARKS[list(b".,!?;:#*$%&|+-/()")] = True
_LONGEST_TAIL = 8
_OTHER, _ANGLE, _HIGH = 1, 2, 4  # what a byte is if neither white space nor a letter: any, "<", beyond ASCII
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[0x80:] |= _HIGH
_KIND[ord("<")] |= _ANGLE
_KIND[T.IS_SPACE] = 0
_KIND[[*range(65, 91), *range(97, 123)]] = 0
_KIND_OF_BYTE = _KIND.tobytes()


def _letters_of_bytes() -> np.ndarray:
    """The vocabulary's letter for each byte of a part of letters, Latin letters in lower case."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    letter = np.array([byte if byte in own else next(others) for byte in range(256)], "<u4")
    letter[0x80:0x9F] = letter[0xA0:0xBF]
    letter[10] = 10  # parts stand on lines of their own
    return letter


_LETTER_OF_BYTE = _letters_of_bytes()


class WordTokens:
    """Token ids of texts, part by part: the vocabulary never joins what white space parts, nor a
    letter and a punctuation mark after it. So words lose their last marks, words whose case does
    not matter are put in lower case, and each distinct part is encoded once and kept (at most
    ``CACHED_WORDS`` of them) in a table of hashes with open addressing. Parts of letters only are
    merged by the vocabulary's model alone: nothing else would change or cut them."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(1 << 16, np.uint64)  # hash of the part in each slot, 0 if there is none
        self.number = np.zeros(1 << 16, np.int32)  # its number
        self.known = 0
        self.begin = np.zeros(1 << 16, np.int64)  # each part's first id, by number, and the end of the last
        self.ids = np.zeros(1 << 16, np.uint32)

    def _slots(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each hash, or the empty one where it belongs."""
        mask = len(self.keys) - 1
        slots = (hashes & np.uint64(mask)).astype(np.int64)
        held = self.keys[slots]
        taken = np.flatnonzero((held != hashes) & (held != 0))
        while len(taken):
            slots[taken] = (slots[taken] + 1) & mask
            held = self.keys[slots[taken]]
            taken = taken[(held != hashes[taken]) & (held != 0)]
        return slots

    def _enter(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        """Gives each of the distinct new hashes a slot."""
        while len(hashes):
            slots = self._slots(hashes)
            self.keys[slots] = hashes
            stays = self.keys[slots] == hashes  # of several in one empty slot one stays
            self.number[slots[stays]] = numbers[stays]
            hashes, numbers = hashes[~stays], numbers[~stays]

    def _learn(self, hashes: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        k, n, used = self.known, len(hashes), int(self.begin[self.known])
        while used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while k + n >= len(self.begin):
            self.begin = np.concatenate([self.begin, np.zeros_like(self.begin)])
        if 2 * (k + n) > len(self.keys):
            old, kept = self.keys, self.number
            size = 1 << (4 * (k + n) - 1).bit_length()
            self.keys, self.number = np.zeros(size, np.uint64), np.zeros(size, np.int32)
            self._enter(old[old > 0], kept[old > 0])
        self.ids[used:used + len(ids)] = ids
        self.begin[k + 1:k + n + 1] = used + np.cumsum(counts)
        self._enter(hashes, np.arange(k, k + n, dtype=np.int32))
        self.known += n

    def _encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, letters: bool) -> tuple[np.ndarray, np.ndarray]:
        if letters:
            size = ends - starts + 1
            stops = np.cumsum(size)
            line = _LETTER_OF_BYTE[data[np.minimum(np.repeat(starts - stops + size, size) + np.arange(stops[-1]), len(data) - 1)]]
            line[stops - 1] = 10
            found = list(map(self.model.tokenize, line[:-1].tobytes().decode("utf-32-le").split("\n")))
            counts = np.fromiter(map(len, found), np.int64, len(found))
            return np.fromiter(map(attrgetter("id"), chain.from_iterable(found)), np.uint32, counts.sum()), counts
        raw = data.tobytes()
        parts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        found = [x.ids for x in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
        return np.array([i for x in found for i in x], np.uint32), np.array([len(x) for x in found], np.int64)

    @staticmethod
    def parts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The bytes with case taken out where it does not matter, the parts' starts and ends, whether
        a part is letters only, and each text's first part."""
        starts, ends, first = T.word_spans(data, offsets)
        if not len(starts):
            return data, starts, ends, np.zeros(0, bool), first
        kind = np.frombuffer(data.tobytes().translate(_KIND_OF_BYTE), np.uint8).copy()
        lead = np.flatnonzero(data[:-1] == _LATIN_LEAD)
        lead = lead[_LATIN_LETTER[data[lead + 1]]]
        kind[lead] = kind[lead + 1] = 0
        held = np.bitwise_or.reduceat(kind, starts)  # of the word, as white space adds nothing
        plain = held & _ANGLE == 0  # no "<": a special token may be spelled there
        odd = held & (_ANGLE | _HIGH) > 0

        stop = ends.copy()
        live = np.flatnonzero(held)
        for _ in range(_LONGEST_TAIL):
            last = stop[live] - 1
            live = live[(last > starts[live]) & _MARKS[data[last]]]
            stop[live] -= 1
        cut = np.flatnonzero(plain & (stop < ends))
        before = data[stop[cut] - 1]
        cut = cut[(kind[stop[cut] - 1] == 0) | ((before >= 48) & (before <= 57))]
        if odd.any():
            edge = np.zeros(len(data) + 1, np.int32)
            edge[starts[odd]] += 1
            edge[ends[odd]] -= 1
            data = np.where(np.cumsum(edge[:-1]) > 0, data, T.lower(data))
        else:
            data = T.lower(data)
        letters = held == 0
        if len(cut):
            letters[cut] = np.bitwise_or.reduceat(kind, np.stack([starts[cut], stop[cut]], 1).ravel())[::2] == 0
            lows, highs, letters = np.insert(starts, cut + 1, stop[cut]), np.insert(ends, cut, stop[cut]), np.insert(letters, cut + 1, False)
            first = first + np.searchsorted(cut, first)
        else:
            lows, highs = starts, ends
        return data, lows, highs, letters, first

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts and the bounds of each text in them."""
        data, starts, ends, letters, first = self.parts(data, offsets)
        hashes = np.maximum(T.span_hash(T.prefix_hash(data), starts, ends), 1)
        slots = self._slots(hashes)
        unknown = np.flatnonzero(self.keys[slots] == 0)
        distinct, where = np.unique(hashes[unknown], return_index=True)
        if self.known and self.known + len(distinct) > CACHED_WORDS:
            self._clear()
            unknown = np.arange(len(hashes))
            distinct, where = np.unique(hashes, return_index=True)
        new = unknown[where]
        for kind in (True, False):
            missing = np.flatnonzero(letters[new] == kind)
            for k in range(0, len(missing), 5_000):
                part = missing[k:k + 5_000]
                self._learn(distinct[part], *self._encode(data, starts[new[part]], ends[new[part]], kind))
        at = self.number[self._slots(hashes) if len(new) else slots]
        begin = self.begin[at]
        counts = self.begin[at + 1] - begin
        bounds = np.zeros(len(at) + 1, np.int64)
        np.cumsum(counts, out=bounds[1:])
        ids = self.ids[np.repeat(begin - bounds[:-1], counts) + np.arange(bounds[-1])]
        return ids, bounds[first]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)`` of every row of ``docs(doc_id, text)``: its ids
    and then ``end_id``, cut every ``capacity`` ids. A null or empty text is its end alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = T.kept(("packing", tokenizer), lambda: WordTokens(tokenizer))
        for batch in batches:
            for row, stop, data, offsets in T.slices(batch.column(1), T.RUN_BYTES):
                ids, bounds = tokens.encode(data, offsets)
                which, piece, start, length, crc = [], [], [], [], []
                for k in range(stop - row):
                    own = np.append(ids[bounds[k]:bounds[k + 1]], np.uint32(end_id)).astype("<u4")
                    for p, s in enumerate(range(0, len(own), capacity)):
                        part = own[s:s + capacity]
                        which.append(row + k)
                        piece.append(p)
                        start.append(s)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(which, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                    ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def patterns(classes: list[int], full: int) -> np.ndarray:
    """All triples of ``classes`` (0: none) in rising order whose sum is ``full``."""
    present = np.zeros(full + 1, bool)
    present[[0, *classes]] = True
    a = np.flatnonzero(present)
    low, middle = (x.ravel() for x in np.meshgrid(a, a, indexing="ij"))
    high = full - low - middle
    keep = (low <= middle) & (middle <= high)
    low, middle, high = low[keep], middle[keep], high[keep]
    return np.stack([low, middle, high], 1)[present[high]]


def nnls(rows: np.ndarray, values: np.ndarray, b: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """Non-negative least squares by the active-set method of Lawson and Hanson. Column ``k`` has
    ``values[k]`` in ``rows[k]`` and 0 elsewhere; values of a repeated row are added up."""
    m, n = len(b), len(rows)
    x, active = np.zeros(n), np.zeros(n, bool)
    chosen: list[int] = []  # the active columns as the columns of `part`, their products in `gram`
    part, gram = np.zeros((m, 0)), np.zeros((0, 0))
    tolerance = 1e-9 * max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(rounds or 3 * m):
        gain = (values * (b - part @ x[chosen])[rows]).sum(1)
        gain[active] = -np.inf
        best = int(np.argmax(gain)) if n else 0
        if not n or gain[best] <= tolerance:
            break
        column = np.zeros((m, 1))
        np.add.at(column[:, 0], rows[best], values[best])
        side = part.T @ column
        part, gram = np.hstack([part, column]), np.block([[gram, side], [side.T, column.T @ column]])
        chosen.append(best)
        active[best] = True
        while True:
            s = np.linalg.solve(gram + 1e-10 * np.eye(len(chosen)), part.T @ b)
            if s.min() > 0:
                x[chosen] = s
                break
            low = s <= 0
            old = x[chosen]
            step = np.min(old[low] / np.maximum(old[low] - s[low], 1e-300))
            x[chosen] = np.maximum(old + step * (s - old), 0)
            gone = low & (x[chosen] <= tolerance)
            left = np.flatnonzero(~gone)
            for k in np.flatnonzero(gone):
                x[chosen[k]], active[chosen[k]] = 0, False
            chosen, part, gram = [chosen[k] for k in left], part[:, left], gram[np.ix_(left, left)]
            if not gone.any():
                x[best] = 0
                return x
            if not chosen:
                break
    return x


Segment = tuple[int, int, int, int]  # first rank, number of pieces, first sequence, offset


def plan(histogram: dict[int, int], capacity: int = CAPACITY, width: int = CLASS_WIDTH) -> tuple[dict[int, list[Segment]], int]:
    """Where the pieces of each length go, by their rank in it, and the number of sequences."""
    left = {n: c for n, c in sorted(histogram.items()) if c > 0}
    given: dict[int, int] = defaultdict(int)
    places: dict[int, list[Segment]] = defaultdict(list)
    sequences = 0
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # open tokens -> runs (first sequence, count)

    def put(length: int, count: int, first: int, used: int) -> None:
        places[length].append((given[length], count, first, used))
        given[length] += count
        left[length] -= count
        if not left[length]:
            del left[length]

    full = capacity // width
    up = lambda n: -(-n // width)
    classes: dict[int, list[int]] = defaultdict(list)
    for n in left:
        classes[up(n)].append(n)
    triples = patterns(sorted(classes), full) if capacity % width == 0 else np.zeros((0, 3), int)
    if len(triples):
        present = np.array(sorted(classes))
        b = np.array([sum(left[n] for n in classes[c]) for c in present.tolist()], float)
        weight = np.maximum(present / full, 0.05)  # a long piece left over costs more
        rows = np.searchsorted(present, triples) * (triples > 0)
        repeats = nnls(rows, weight[rows] * (triples > 0), b * weight, rounds=2 * len(present))
        for k in np.argsort(-repeats, kind="stable"):
            times = int(repeats[k] + 1e-6)
            if not times:
                break
            members = [int(c) for c in triples[k] if c]
            for c in set(members):
                times = min(times, sum(left.get(n, 0) for n in classes[c]) // members.count(c))
            while times > 0:  # runs of sequences whose pieces have the very same lengths
                chosen, taken = [], defaultdict(int)
                for c in members:
                    n = next(x for x in reversed(classes[c]) if left.get(x, 0) > taken.get(x, 0))
                    chosen.append(n)
                    taken[n] += 1
                run = min(times, *(left[n] // t for n, t in taken.items()))
                used = 0
                for n in sorted(chosen, reverse=True):
                    put(n, run, sequences, used)
                    used += n
                gaps[capacity - used].append((sequences, run))
                sequences += run
                times -= run
    open_gaps = sorted(g for g, runs in gaps.items() if runs and g)
    for n in sorted(left, reverse=True):
        while n in left:
            at = bisect.bisect_left(open_gaps, n)
            if at == len(open_gaps):  # open as many new sequences as these pieces fill
                per = capacity // n
                whole, rest = divmod(left[n], per)
                for count, each in ((whole, per), (1 if rest else 0, rest)):
                    if count:
                        for k in range(each):
                            put(n, count, sequences, k * n)
                        gap = capacity - each * n
                        if gap:
                            if not gaps[gap]:
                                bisect.insort(open_gaps, gap)
                            gaps[gap].append((sequences, count))
                        sequences += count
                continue
            gap = open_gaps[at]
            first, count = gaps[gap].pop()
            run = min(count, left[n])
            if run < count:
                gaps[gap].append((first + run, count - run))
            if not gaps[gap]:
                open_gaps.pop(at)
            put(n, run, first, capacity - gap)
            if gap > n:
                if not gaps[gap - n]:
                    bisect.insort(open_gaps, gap - n)
                gaps[gap - n].append((first, run))
    return dict(places), sequences


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``found(doc_id, piece, length, ...)`` with ``sequence_id`` and ``offset``: every piece is in
    one sequence of at most ``capacity`` tokens, without gaps. Lengths lie between 1 and
    ``capacity``. Repeated rows are packed one by one; an empty table gives an empty result."""
    found = stable(found)
    counts = {int(r[0]): int(r[1]) for r in found.groupBy("length").count().collect()}  # at most `capacity` rows
    places, _ = plan(counts, capacity)
    rows = [(n, -(-counts[n] // RANGE_ROWS), *(list(x) for x in zip(*((s[0], s[2], s[3]) for s in segments), strict=True)))
            for n, segments in places.items()]
    table = F.broadcast(found.sparkSession.createDataFrame(
        rows, "length bigint, ranges bigint, first array<bigint>, sequence array<bigint>, at array<bigint>"))
    placed = found.join(table.select("length", "ranges"), "length").withColumn(
        "_range", F.pmod(F.xxhash64("doc_id", "piece"), "ranges")).drop("ranges")
    sums = placed.groupBy("length", "_range").agg(F.count("*").alias("_n"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_n").over(
        Window.partitionBy("length").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    ranked = placed.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_range").orderBy("doc_id", "piece"))) \
        .join(before, ["length", "_range"])
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_rank") - 1).join(table, "length")
    segment = F.expr("size(filter(first, f -> f <= _rank))")
    return ranked.withColumn("_segment", segment).select(
        *found.columns,
        (F.element_at("sequence", F.col("_segment")) + F.col("_rank") - F.element_at("first", F.col("_segment"))).alias("sequence_id"),
        F.element_at("at", F.col("_segment")).alias("offset"))
