"""Quality rules: statistics of whole texts, judged by gradient-boosted trees.

The trees are fitted on labelled rows (at most ``max_rows``, those of the smallest hash) and
flattened into node arrays; scoring walks all rows one level at a time. Chosen features carry a
monotonic constraint: more repeats, symbols, capitals or exclamation marks never raise a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratamart.llm import text as T

WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 5, 10, 20
SYMBOLS = b"#*$%&|<>"

# feature -> direction in which it may move the score (0: either)
FEATURES = {
    "n_words": 0, "word_length": 0, "symbols_per_word": -1, "dup_line_share": -1, "repeat_share": -1,
    "upper_share": -1, "exclamations_per_word": -1, "twin_share": -1, "distinct_share": 0, "words_per_line": 0,
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

_symbol = np.zeros(256, bool)
_symbol[list(SYMBOLS)] = True


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def statistics(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Every count and feature of the texts between ``offsets``."""
    n = len(offsets) - 1
    starts, ends, first = T.word_spans(data, offsets)
    words = np.diff(first)
    prefix = T.prefix_hash(data)
    hashes = T.span_hash(prefix, starts, ends)
    chars = _per_text((data & 0xC0) != 0x80, offsets)
    white = _per_text(T.IS_SPACE[data], offsets)
    # lines: a text is cut at each \n; only lines with a word count
    cuts = np.flatnonzero(data == 10)
    begins = np.unique(np.concatenate([offsets[:-1], cuts + 1]))
    begins = begins[begins < len(data)]
    stops = np.append(begins[1:], len(data))
    stops = stops - ((stops > begins) & (data[np.maximum(stops, 1) - 1] == 10)) if len(begins) else stops
    owner = np.searchsorted(offsets, begins, "right") - 1
    has_word = np.searchsorted(starts, stops) > np.searchsorted(starts, begins)
    line_hash, line_owner = T.span_hash(prefix, begins, stops)[has_word], owner[has_word]
    order = np.lexsort((line_hash, line_owner))
    again = np.zeros(len(order), bool)
    again[1:] = (line_hash[order][1:] == line_hash[order][:-1]) & (line_owner[order][1:] == line_owner[order][:-1])
    dup_lines = np.bincount(line_owner[order][again], minlength=n)
    lines = np.bincount(line_owner, minlength=n)
    # words in windows that occur twice or more in their text
    grams, bounds = T.windows(hashes, first, WINDOW)
    covered = np.zeros(len(hashes) + 1, np.int64)
    distinct = np.zeros(n, np.int64)
    for k in range(n):
        own = grams[bounds[k]:bounds[k + 1]]
        if len(own) > 1:
            order = np.argsort(own, kind="stable")
            same = own[order][1:] == own[order][:-1]
            repeated = np.zeros(len(own), bool)
            repeated[1:] |= same
            repeated[:-1] |= same
            at = order[repeated] + first[k]
            covered[at] += 1  # each window occurs once in order
            covered[at + WINDOW] -= 1
        distinct[k] = len(np.unique(hashes[first[k]:first[k + 1]]))
    repeat_words = _per_text(np.cumsum(covered[:-1]) > 0, first)
    twins = np.zeros(len(hashes), bool)
    twins[1:] = hashes[1:] == hashes[:-1]
    twins[first[:-1][words > 0]] = False
    upper = _per_text((data >= 65) & (data <= 90), offsets)
    symbols = _per_text(_symbol[data], offsets)
    some = np.maximum(words, 1)
    return {
        "n_words": words, "word_chars": chars - white, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": repeat_words,
        "word_length": (chars - white) / some, "symbols_per_word": symbols / some, "dup_line_share": dup_lines / np.maximum(lines, 1),
        "repeat_share": repeat_words / some, "upper_share": upper / np.maximum(chars - white, 1),
        "exclamations_per_word": _per_text(data == 33, offsets) / some, "twin_share": _per_text(twins, first) / some,
        "distinct_share": distinct / some, "words_per_line": words / np.maximum(lines, 1),
    }


_NAMES = list(dict.fromkeys(COUNTS + list(FEATURES)))
_SCHEMA = "doc_id bigint, " + ", ".join(f"{c} {'bigint' if c in COUNTS else 'double'}" for c in _NAMES)


def document_statistics(docs: DataFrame, key: str | None = None) -> DataFrame:
    """One row of counts and features per row of ``docs(doc_id, text)``; a null text has none. A
    ``key`` column (bigint) of ``docs`` is carried through."""
    extra = [key] if key else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        T.kept(None)
        for batch in batches:
            for row, stop, data, offsets in T.slices(batch.column(1), T.RUN_BYTES):
                found = statistics(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, stop - row), *(pa.array(found[c].astype(np.int64 if c in COUNTS else np.float64)) for c in _NAMES),
                     *(c.slice(row, stop - row) for c in batch.columns[2:])],
                    ["doc_id", *_NAMES, *extra])

    return docs.select("doc_id", "text", *extra).mapInArrow(run, _SCHEMA + "".join(f", {c} bigint" for c in extra))


@dataclass(frozen=True)
class Trees:
    """Nodes of all trees, level by level in one array each; a leaf points to itself."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each row of ``x``; NaN goes left."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                right = (x[rows, self.feature[at]] > self.threshold[at]) & (self.left[at] != at)
                at = self.left[at] + right
            total += self.value[at]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, direction: list[int], trees: int = 60, depth: int = 3, rate: float = 0.15,
        bins: int = 64, l2: float = 1.0, min_weight: float = 1.0) -> Trees:
    """Boost log-loss trees on histograms. A split against its feature's direction is not taken,
    and the children of one in its direction keep to their side of the middle of both values."""
    mean = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1) if len(x) else np.zeros(x.shape, int)
    logit = np.full(len(x), base)
    roots, feature, threshold, left, value = [], [], [], [], []

    def node(v: float) -> int:
        for column, item in ((feature, 0), (threshold, np.inf), (left, len(left)), (value, v)):
            column.append(item)
        return len(left) - 1

    for _ in range(trees):
        p = 1 / (1 + np.exp(-logit))
        g, h = y - p, p * (1 - p)
        root = node(0.0)
        roots.append(root)
        level = [(root, np.arange(len(x)), -np.inf, np.inf)]
        for _ in range(depth):
            below = []
            for at, rows, low, high in level:
                sg, sh = g[rows].sum(), h[rows].sum()
                best = (1e-6, None)
                for f, edge in enumerate(edges):
                    if not len(edge):
                        continue
                    gl = np.cumsum(np.bincount(binned[rows, f], g[rows], len(edge) + 1))[:-1]
                    hl = np.cumsum(np.bincount(binned[rows, f], h[rows], len(edge) + 1))[:-1]
                    vl = np.clip(gl / (hl + l2), low, high)
                    vr = np.clip((sg - gl) / (sh - hl + l2), low, high)
                    v = np.clip(sg / (sh + l2), low, high)
                    part = lambda gs, hs, w: 2 * gs * w - (hs + l2) * w * w
                    gain = part(gl, hl, vl) + part(sg - gl, sh - hl, vr) - part(sg, sh, v)
                    gain[(hl < min_weight) | (sh - hl < min_weight) | (direction[f] * (vr - vl) < 0)] = -1
                    k = int(np.argmax(gain))
                    if gain[k] > best[0]:
                        best = (gain[k], (f, k, vl[k], vr[k]))
                if best[1] is None:
                    continue
                f, k, vl, vr = best[1]
                goes = binned[rows, f] > k
                a, b = node(vl * rate), node(vr * rate)
                feature[at], threshold[at], left[at] = f, edges[f][k], a
                middle = (vl + vr) / 2
                sides = {0: (low, high, low, high), 1: (low, middle, middle, high), -1: (middle, high, low, middle)}[direction[f]]
                below += [(a, rows[~goes], sides[0], sides[1]), (b, rows[goes], sides[2], sides[3])]
            level = below
        so_far = Trees(np.array([root]), *map(np.array, (feature, threshold, left, value)), 0.0, depth)
        at = np.full(len(x), root)
        for _ in range(depth):
            right = (x[np.arange(len(x)), so_far.feature[at]] > so_far.threshold[at]) & (so_far.left[at] != at)
            at = so_far.left[at] + right
        logit += so_far.value[at]
    return Trees(np.array(roots), np.array(feature), np.array(threshold), np.array(left), np.array(value), base, depth)


def fit_labels(stats: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> Trees:
    """Fit on at most ``max_rows`` labelled rows, those whose doc_id has the smallest hash. Without
    any labelled row every score is one half."""
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("y"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = known.join(stats.dropDuplicates(["doc_id"]), "doc_id").select("y", *FEATURES).toPandas()
    return fit(rows[list(FEATURES)].to_numpy(np.float64), rows["y"].to_numpy(np.float64), list(FEATURES.values()))


def judged(stats: DataFrame, trees: Trees, bound: float = 0.3) -> DataFrame:
    """``stats`` with ``base_failed``, ``score`` (probability of good quality) and ``kept``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.float64) for c in FEATURES], 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(trees.score(x))], [*batch.schema.names, "score"])

    scored = stats.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in stats.dtypes) + ", score double")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= bound))


def quality_rules(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, bound: float = 0.3, key: str | None = None) -> DataFrame:
    """Statistics, ``base_failed``, ``score`` and ``kept`` for every row of ``docs(doc_id, text)``.

    Null and empty texts have no words and fail the base rules. Repeated rows are all returned;
    other columns are not read but a ``key``, which the result has too. An empty table gives an
    empty result.
    """
    from stratamart.session import stable

    stats = stable(document_statistics(docs, key))
    return judged(stats, fit_labels(stats, labels, max_rows), bound)
