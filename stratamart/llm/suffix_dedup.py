"""Repeated passages: bytes of texts covered by a string of ``LENGTH`` bytes that starts elsewhere too.

Column-wise construction takes one pass over the whole collection for every byte of its longest
text, so it is not run on whole documents. They are first cut so that equal strings of ``LENGTH``
bytes come to the same task: of the ``ANCHOR``-byte strings in each window of ``LENGTH`` bytes the
one of the smallest hash is the window's anchor, which depends on the window's bytes alone. The
consecutive windows of one anchor make a fragment, and every window lies in one fragment.

1. Count the distinct fragments by anchor. Those found twice repeat as a whole. Windows are put
   in ``BANDS`` bands by where the anchor lies in them; all windows of a band share the bytes next
   to the anchor, so a fragment of which no band's shared bytes are those of another fragment does
   not repeat at all. The others are in doubt.
2. Each shard of anchors takes the bytes of its fragments in doubt, one copy each, with a short
   number in place of the anchor, and builds the Burrows-Wheeler transform of the collection column
   by column: every round inserts one more byte of every fragment. Neighbours among the sorted
   suffixes that share a window's bytes are repeated windows.
3. Documents look their fragments up and mark the repeated windows.

What is found is stored per shard as sorted hash arrays in the shared folder, which tasks map into
memory; texts are read three times and never shuffled, only fragment hashes and doubtful bytes are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratamart.llm import text as T
from stratamart.llm.arrays import Arrays, local_path, runs, shard_of, store, summed
from stratamart.session import scratch_path

LENGTH, ANCHOR = 200, 64
SHARD_BYTES = 32 << 20
TASK_FRAGMENTS = 500_000
CELL_BYTES = 16 << 20
COLLECTION_BYTES = 512 << 10
RUN_BYTES = 256 << 10  # texts are cut in runs whose arrays stay in a core's cache
BANDS = 8


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` values in a row."""
    n = len(values)
    if n < width:
        return values[:0]
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


class Fragments:
    """The fragments of a slice of texts: where their windows start, and their hashes.

    With ``bands``, also 32 bits for each fragment and band of a hash of the bytes that all the
    fragment's windows of that band share, 0 where it has no window in the band.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR, bands: bool = False) -> None:
        self.length, self.width = length, anchor
        found, row = [], 0
        while row < len(offsets) - 1:
            stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + RUN_BYTES, "right")) - 1)
            low, high = int(offsets[row]), int(offsets[stop])
            found += self._cut(data[low:high], offsets[row:stop + 1] - low, low, bands)
            row = stop
        none = np.zeros(0, np.int64)
        parts = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [none] * 6
        self.start, self.end, self.windows, self.place, self.anchor, self.hash = parts[:6]
        self.bands = parts[6] if len(parts) > 6 else np.zeros((0, BANDS), np.uint32)

    def _cut(self, data: np.ndarray, offsets: np.ndarray, low: int, bands: bool) -> list[tuple[np.ndarray, ...]]:
        n, length, width = len(data), self.length, self.width
        edge = np.zeros(n + 1, np.int8)  # window starts whose window lies in one text
        room = np.diff(offsets) >= length
        edge[offsets[:-1][room]] = 1
        edge[offsets[1:][room] - length + 1] -= 1
        starts = np.flatnonzero(np.cumsum(edge[:n], dtype=np.int8))
        if not len(starts):
            return []
        prefix = T.prefix_hash(data)
        grams = T.mix((prefix[width:] - prefix[:-width]) * T.powers(n + 1)[1][:n - width + 1] + np.uint64(width))
        bits = np.uint64(int(n).bit_length())
        ranked = (grams >> bits) << bits
        ranked |= np.arange(n - width + 1, dtype=np.uint64)  # ties go to the leftmost
        least = sliding_min(ranked, length - width + 1)[starts]
        head = np.flatnonzero(np.append(True, (least[1:] != least[:-1]) | (starts[1:] != starts[:-1] + 1)))
        place = (least[head] & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
        start, windows = starts[head], np.diff(np.append(head, len(starts)))
        ends = start + windows + length - 1
        shape = ((place - start) * 512 + windows).astype(np.uint64)
        hashes = T.mix(T.span_hash(prefix, start, ends) + shape * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)
        parts = (start + low, ends + low, windows, place + low, grams[place].view(np.int64), hashes)
        return [(*parts, self._bands(prefix, place, place - start, windows)) if bands else parts]

    def _bands(self, prefix: np.ndarray, place: np.ndarray, most: np.ndarray, windows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(place), BANDS), np.uint32)
        least = most - windows + 1  # bytes before the anchor in the last window, and ``most`` in the first
        cuts = np.linspace(0, self.length - self.width + 1, BANDS + 1).astype(int)
        for b, (low, high) in enumerate(zip(cuts[:-1], cuts[1:] - 1, strict=True)):
            has = (most >= low) & (least <= high)
            own = T.span_hash(prefix, place[has] - low, place[has] + self.length - high)
            out[has, b] = (own >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        return out


def _cut_at(bounds: np.ndarray, items: np.ndarray) -> pa.Array:
    """The bytes of the items between bounds, one value each, in the memory of ``items``."""
    offsets = (bounds * (items.nbytes // len(items))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(items)])


def _count_fragments(shards: int):
    """Rows ``(shard, anchors, hashes, counts, bands)`` of the distinct fragments of a task's texts."""

    def flush(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        anchor, hashes, bands = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()  # the arrays are large, and a worker keeps the room that it once took
        _, where, (counts,) = summed(hashes, np.ones(len(hashes), np.int8))
        shard = shard_of(anchor[where], shards)
        order = np.argsort(shard, kind="stable")
        where, shard = where[order], shard[order]
        begins = np.array([s for s, _ in runs(shard)])
        bounds = np.append(begins, len(shard))
        columns = (np.minimum(counts, 2).astype(np.int8)[order] if c is None else c[where] for c in (anchor, hashes, None, bands))
        return pa.RecordBatch.from_arrays(
            [pa.array(shard[begins]), *(_cut_at(bounds, c) for c in columns)],
            ["shard", "anchors", "hashes", "counts", "bands"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        T.kept(None)
        held, size = [], 0
        for batch in batches:
            for _, _, data, offsets in T.slices(batch.column(0)):
                found = Fragments(data, offsets, bands=True)
                if len(found.hash):
                    held.append((found.anchor, found.hash, found.bands))
                    size += len(found.hash)
                if size >= TASK_FRAGMENTS:
                    yield flush(held)
                    size = 0
        if held:
            yield flush(held)

    return run


def _sort_out(folder: str):
    """Store a shard's repeated fragments and those in doubt."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        shard = int(group["shard"].iloc[0])
        anchor, hashes = (np.frombuffer(b"".join(group[c]), np.int64) for c in ("anchors", "hashes"))
        keys, where, (counts,) = summed(hashes, np.frombuffer(b"".join(group["counts"]), np.int8))
        anchor = anchor[where].view(np.uint64)
        bands = np.frombuffer(b"".join(group["bands"]), np.uint32).reshape(-1, BANDS)[where]
        shared = np.zeros(len(keys), bool)
        for b in range(BANDS):
            at = np.flatnonzero(bands[:, b])
            context = T.mix(anchor[at] + bands[at, b])
            order = np.argsort(context, kind="stable")
            same = context[order][1:] == context[order][:-1]
            shared[at[order[1:][same]]] = True
            shared[at[order[:-1][same]]] = True
        store(folder, f"repeated-{shard}", keys[counts > 1])
        store(folder, f"doubtful-{shard}", keys[shared])
        return pd.DataFrame([(shard, len(keys), int((counts > 1).sum()), int(shared.sum()))], columns=["shard", "fragments", "repeated", "doubtful"])

    return run


def _doubtful_bytes(folder: str, shards: int, cells: int):
    """Rows ``(cell, hash, anchor, before, after)`` of the fragments in doubt, once each per slice, with
    the bytes on both sides of the anchor; all fragments of an anchor are in one cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = Arrays(folder)
        for batch in batches:
            for _, _, data, offsets in T.slices(batch.column(0)):
                found = Fragments(data, offsets)
                raw = None
                for _, at, _ in marks.places("doubtful", shard_of(found.anchor, shards), found.hash):
                    keys, where = np.unique(found.hash[at], return_index=True)
                    if len(keys):
                        raw = raw or data.tobytes()
                        at = at[where]
                        before = [raw[a:b] for a, b in zip(found.start[at], found.place[at], strict=True)]
                        after = [raw[a:b] for a, b in zip(found.place[at] + ANCHOR, found.end[at], strict=True)]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(shard_of(found.anchor[at], cells)), pa.array(keys), pa.array(found.anchor[at]), pa.array(before, pa.binary()), pa.array(after, pa.binary())],
                            ["cell", "hash", "anchor", "before", "after"])

    return run


MARK, NUMBER = 255, 254  # no bytes of UTF-8


def column_wise_bwt(texts: list[bytes]) -> np.ndarray:
    """The Burrows-Wheeler transform of a collection, by inserting one byte of every text a round.

    Every text ends with a mark of its own, smaller than all bytes; the marks rank as the texts.
    In round ``j`` the suffix of ``j`` bytes of each text that is long enough takes its place: with
    ``c`` its first byte, after all marks, all suffixes that begin with less, and those that begin
    with ``c`` and go on with a smaller suffix; that many ``c`` stand before the place of the
    text's last suffix in the transform so far. Gives, in the order of the sorted suffixes, each
    one's preceding byte, ``MARK`` where it is a whole text.

    The bytes of the last rounds are kept apart, with their places, and join the transform when
    they are a sixteenth of it, so it need not be written and counted anew every round.
    """
    m = len(texts)
    lengths = np.array([len(t) for t in texts], np.int64)
    flat = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum(lengths)
    used = np.flatnonzero(np.bincount(flat, minlength=256))
    code = np.zeros(256, np.uint8)
    code[used] = np.arange(len(used))
    flat, mark = code[flat], len(used)
    transform = np.full(m, mark, np.uint8)
    going = np.flatnonzero(lengths)
    transform[going] = flat[ends[going] - 1]
    keys = _by_byte(transform)
    late, late_place = transform[:0], ends[:0]
    late_keys = _by_byte(late)
    place = np.arange(m)
    for j in range(1, int(lengths.max(initial=0)) + 1):
        going = going[lengths[going] >= j]
        first = flat[ends[going] - j].astype(np.int64) << PLACE_BITS
        before = np.searchsorted(late_place, place[going])
        new = m + np.searchsorted(keys, first + place[going] - before) + np.searchsorted(late_keys, first + before)
        place[going] = new
        order = np.argsort(new)
        following = np.where(lengths[going] == j, mark, flat[np.maximum(ends[going] - j - 1, 0)]).astype(np.uint8)[order]
        new = new[order]
        late_place = late_place + np.searchsorted(new - np.arange(len(new)), late_place, "right")
        late_place = np.concatenate([late_place, new])
        order = np.argsort(late_place, kind="stable")
        late, late_place = np.concatenate([late, following])[order], late_place[order]
        if 16 * len(late) >= len(transform):
            transform = _joined(transform, late, late_place)
            keys = _by_byte(transform)
            late, late_place = late[:0], late_place[:0]
        late_keys = _by_byte(late)
    return np.append(used, MARK).astype(np.uint8)[_joined(transform, late, late_place)]


PLACE_BITS = 48


def _by_byte(transform: np.ndarray) -> np.ndarray:
    """Sorted pairs (byte rank, place) in one number each. How many are below one of them is what all
    lower bytes and the equal ones before it in ``transform`` put before a suffix."""
    order = np.argsort(transform, kind="stable")
    return (transform[order].astype(np.int64) << PLACE_BITS) + order


def _joined(transform: np.ndarray, late: np.ndarray, late_place: np.ndarray) -> np.ndarray:
    """``transform`` with the bytes ``late`` put in, which are then at ``late_place``."""
    fresh = np.zeros(len(transform) + len(late), bool)
    fresh[late_place] = True
    grown = np.empty(len(fresh), np.uint8)
    grown[late_place] = late
    grown[~fresh] = transform
    return grown


def repeated_windows(texts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each text, which of its windows of ``length`` bytes occur elsewhere in the collection.

    The suffixes are found again by walking each text from its mark through the transform; those
    of ``length`` bytes or more that are next to each other are compared by their first bytes.
    """
    m = len(texts)
    transform = column_wise_bwt(texts)
    by_byte = np.argsort(transform, kind="stable")
    step = np.empty(len(transform), np.int64)
    step[by_byte] = m + np.arange(len(transform))
    lengths = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    place, going = np.arange(m), np.arange(m)
    ranks, owners, starts = [], [], []
    for j in range(1, int(lengths.max(initial=0)) + 1):
        going = going[lengths[going] >= j]
        place[going] = step[place[going]]
        if j >= length:
            ranks.append(place[going])
            owners.append(going)
            starts.append(bounds[going + 1] - j)
    out = [np.zeros(max(0, n - length + 1), bool) for n in lengths]
    if not ranks:
        return out
    ranks, owners, starts = (np.concatenate(x) for x in (ranks, owners, starts))
    order = np.argsort(ranks, kind="stable")
    owners, starts = owners[order], starts[order]
    prefix = T.span_hash(T.prefix_hash(data), starts, starts + length)
    same = np.append(False, prefix[1:] == prefix[:-1])
    same[:-1] |= same[1:]
    flags = np.zeros(len(data), bool)
    flags[starts[same]] = True
    for k in range(m):
        out[k] = flags[bounds[k]:bounds[k] + len(out[k])]
    return out


BITS = -(-(LENGTH - ANCHOR + 1) // 8)


def _numbered(anchors: np.ndarray, before: list[bytes], after: list[bytes]) -> tuple[list[bytes], int]:
    """The fragments with the number of their anchor, behind a byte that texts don't have, in place of
    its bytes, and how many bytes the number takes. Every window has its whole anchor, so windows
    agree with a number in it as they do with the anchor."""
    kinds, number = np.unique(anchors, return_inverse=True)
    digits = 1
    while 64 ** digits < len(kinds):
        digits += 1
    marks = [bytes([NUMBER, *((k >> 6 * d & 63) + 64 for d in range(digits))]) for k in range(len(kinds))]
    return [a + marks[k] + b for a, k, b in zip(before, number.tolist(), after, strict=True)], 1 + digits


def _resolve(folder: str):
    """Store which windows of a cell's fragments in doubt repeat. Fragments of other anchors have no
    window in common, so a collection is those of as many anchors as make ``COLLECTION_BYTES``."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("hash").sort_values(["anchor", "hash"])
        anchors, hashes = (group[c].to_numpy(np.int64) for c in ("anchor", "hash"))
        before, after = list(group["before"]), list(group["after"])
        sizes = np.cumsum([len(a) + len(b) for a, b in zip(before, after, strict=True)])
        bits = np.zeros((len(group), BITS), np.uint8)
        begin = 0
        while begin < len(group):
            end = int(np.searchsorted(sizes, sizes[begin] + COLLECTION_BYTES, "right"))
            end = int(np.searchsorted(anchors, anchors[end - 1], "right"))  # the last anchor's all
            texts, width = _numbered(anchors[begin:end], before[begin:end], after[begin:end])
            for k, own in enumerate(repeated_windows(texts, LENGTH - ANCHOR + width), begin):
                if own.any():
                    own = np.packbits(own)
                    bits[k, :len(own)] = own
            begin = end
        order = np.argsort(hashes)
        order = order[bits[order].any(1)]
        cell = int(group["cell"].iloc[0])
        store(folder, f"partial-{cell}", hashes[order])
        store(folder, f"partial-bits-{cell}", bits[order])
        return pd.DataFrame([(cell, len(order))], columns=["cell", "partial"])

    return run


class Repeats:
    """Where the marks of a collection are stored."""

    def __init__(self, folder: str, shards: int, cells: int) -> None:
        self.folder, self.shards, self.cells = folder, shards, cells

    def cover(self, marks: Arrays, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which bytes of the texts lie in a repeated window."""
        found = Fragments(data, offsets)
        edge = np.zeros(len(data) + 1, np.int32)
        for _, at, _ in marks.places("repeated", shard_of(found.anchor, self.shards), found.hash):
            np.add.at(edge, found.start[at], 1)
            np.add.at(edge, found.end[at], -1)
        for cell, at, place in marks.places("partial", shard_of(found.anchor, self.cells), found.hash):
            bits = np.unpackbits(marks.array(f"partial-bits-{cell}")[place], axis=1)
            row, window = np.nonzero(bits)
            np.add.at(edge, found.start[at][row] + window, 1)
            np.add.at(edge, found.start[at][row] + window + LENGTH, -1)
        return np.cumsum(edge, out=edge)[:-1] > 0


def find_repeats(texts: DataFrame, shard_bytes: int = SHARD_BYTES) -> Repeats:
    """Find and store the repeated windows of ``texts(text)``; a null text is an empty one."""
    spark = texts.sparkSession
    column = texts.select("text")
    size = column.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    folder = local_path(scratch_path(spark, "repeats"))
    counted = column.mapInArrow(_count_fragments(shards), "shard bigint, anchors binary, hashes binary, counts binary, bands binary")
    sizes = counted.groupBy("shard").applyInPandas(_sort_out(folder), "shard bigint, fragments bigint, repeated bigint, doubtful bigint")
    most = sizes.agg(F.max("doubtful")).first()[0] or 0  # asked once, so not stored
    cells = shards * max(1, -(-most * 2 * LENGTH // CELL_BYTES))
    doubtful = column.mapInArrow(_doubtful_bytes(folder, shards, cells), "cell bigint, hash bigint, anchor bigint, before binary, after binary")
    doubtful.groupBy("cell").applyInPandas(_resolve(folder), "cell bigint, partial bigint").agg(F.sum("partial")).collect()
    return Repeats(folder, shards, cells)


def _counts(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of each text's flags are set."""
    total = np.zeros(len(flags) + 1, np.int32)  # a slice has fewer than 2 GB
    np.cumsum(flags, out=total[1:])
    return np.diff(total[offsets]).astype(np.int64)


def repeated_bytes(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` for every row of ``docs(doc_id, text)``.

    Texts are taken as UTF-8 bytes, null as none. Repeated rows cover each other whole (from
    ``LENGTH`` bytes on), as does any passage of one text that recurs in it. Other columns are
    not read.
    """
    repeats = find_repeats(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = Arrays(repeats.folder)
        for batch in batches:
            for row, stop, data, offsets in T.slices(batch.column(1)):
                cover = repeats.cover(marks, data, offsets)
                begins = cover.copy()
                begins[1:] &= ~cover[:-1]
                heads = offsets[:-1][np.diff(offsets) > 0]
                begins[heads] = cover[heads]
                kept = [hashlib.sha256(data[a:b][~cover[a:b]].tobytes()).hexdigest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, stop - row), pa.array(np.diff(offsets)), *(pa.array(_counts(x, offsets)) for x in (cover, begins)), pa.array(kept)],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated bytes taken out of ``text``, and ``n_chars`` (if there) counted
    anew. What a cut leaves of a character goes too. A null text stays null."""
    repeats = find_repeats(docs)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = Arrays(repeats.folder)
        for batch in batches:
            texts = batch.column(names.index("text"))
            kept: list[str | None] = []
            for row, stop, data, offsets in T.slices(texts):
                cover = repeats.cover(marks, data, offsets)
                for k, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
                    whole = texts[row + k].is_valid
                    kept.append(data[a:b][~cover[a:b]].tobytes().decode("utf-8", "ignore") if whole else None)
            columns = list(batch.columns)
            columns[names.index("text")] = pa.array(kept, pa.string())
            if "n_chars" in names:
                columns[names.index("n_chars")] = pa.array([None if t is None else len(t) for t in kept], pa.int64())
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, docs.schema)
