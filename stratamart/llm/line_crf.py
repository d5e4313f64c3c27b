"""Document quality from its lines: a linear-chain conditional random field.

Every line with a word is labelled good or bad, from its own features and those of the lines next
to it, with weights for each change of label. A document's score is the mean of its lines' chances
of being good (forward-backward marginals), weighted by their words.

Labels exist for whole documents; in training each line has its document's. The field is fitted on
at most ``max_docs`` labelled documents, those of the smallest hash; scoring covers all texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratamart.llm import text as T

OWN = ["upper", "symbols", "exclamations", "bars", "twins", "distinct", "digits", "words", "word_length", "stop", "again"]
MAX_DOCS, ROUNDS = 4000, 150

_symbol = np.zeros(256, bool)
_symbol[list(b"#*$%&|<>")] = True


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features and words of the lines that have a word, and each text's first line."""
    starts, ends, first_word = T.word_spans(data, offsets)
    prefix = T.prefix_hash(data)
    hashes = T.span_hash(prefix, starts, ends)
    cuts = np.flatnonzero(data == 10) + 1
    begins = np.unique(np.concatenate([offsets[:-1], cuts]))
    begins = begins[begins < len(data)]
    stops = np.append(begins[1:], len(data)) if len(begins) else begins
    low, high = np.searchsorted(starts, begins), np.searchsorted(starts, stops)
    some = high > low
    begins, stops, low, high = begins[some], stops[some], low[some], high[some]
    owner = np.searchsorted(offsets, begins, "right") - 1
    first = np.searchsorted(owner, np.arange(len(offsets)))
    if not len(begins):
        return np.zeros((0, len(OWN))), np.zeros(0, np.int64), first

    def share(flags: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[stops] - total[begins]

    words = high - low
    chars = np.maximum(share(((data & 0xC0) != 0x80) & ~T.IS_SPACE[data]), 1)
    twins = np.zeros(len(hashes) + 1, np.int64)
    np.cumsum(np.append(False, hashes[1:] == hashes[:-1]), out=twins[1:])
    order = np.lexsort((hashes, np.repeat(np.arange(len(low)), words)))
    line_of = np.repeat(np.arange(len(low)), words)
    fresh = np.ones(len(order), bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (line_of[order][1:] != line_of[order][:-1])
    distinct = np.bincount(line_of[order][fresh], minlength=len(low))
    trimmed = ends[high - 1]
    line_hash = T.span_hash(prefix, starts[low], trimmed)
    order = np.lexsort((np.arange(len(low)), line_hash, owner))
    again = np.zeros(len(low), bool)
    again[order[1:]] = (line_hash[order][1:] == line_hash[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    last = data[trimmed - 1]
    own = np.stack([
        share((data >= 65) & (data <= 90)) / chars, np.minimum(share(_symbol[data]) / words, 3) / 3, np.minimum(share(data == 33) / words, 2) / 2,
        np.minimum(share(data == 124) / words, 1), np.maximum(twins[high] - twins[np.minimum(low + 1, high)], 0) / words, distinct / words,
        share((data >= 48) & (data <= 57)) / chars, np.minimum(np.log1p(words), 8) / 8, np.minimum(chars / words, 20) / 20,
        (last == 46) | (last == 33) | (last == 63), again,
    ], 1).astype(np.float64)
    return own, words, first


def with_neighbours(own: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A constant, the features of each line, and those of the line before and after (0 at the ends)."""
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    heads = first[:-1][np.diff(first) > 0]
    tails = first[1:][np.diff(first) > 0] - 1
    before[heads], after[tails] = 0, 0
    return np.concatenate([np.ones((len(own), 1)), own, before, after], 1)


@dataclass(frozen=True)
class Field:
    """Line weights for the label good, the 2 x 2 weights of label changes, and the share of good
    documents in training, which is the score of a text without a line."""

    weights: np.ndarray
    changes: np.ndarray
    prior: float


def _chains(score: np.ndarray, changes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log messages forward and backward for all chains, one step of every chain at a time."""
    n = len(score)
    unary = np.stack([np.zeros(n), score], 1)
    lengths = np.diff(first)
    order = np.argsort(-lengths, kind="stable")
    heads, lengths = first[:-1][order], lengths[order]
    forward, backward = unary.copy(), np.zeros((n, 2))
    longest = int(lengths[0]) if len(lengths) else 0
    counts = np.searchsorted(-lengths, -np.arange(longest), "left")
    for t in range(1, longest):
        at = heads[:counts[t]] + t
        forward[at] += np.logaddexp(forward[at - 1, :1] + changes[0], forward[at - 1, 1:] + changes[1])
    for t in range(longest - 1, 0, -1):
        at = heads[:counts[t]] + t
        came = backward[at] + unary[at]
        backward[at - 1] = np.logaddexp(changes[:, 0] + came[:, :1], changes[:, 1] + came[:, 1:])
    return forward, backward


def marginals(field: Field, x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The chance of each line to be good."""
    forward, backward = _chains(x @ field.weights, field.changes, first)
    both = forward + backward
    return 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -700, 700)))


def fit(x: np.ndarray, first: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, l2: float = 1.0, rate: float = 0.1) -> Field:
    """Maximise the likelihood of the line labels; every document counts alike."""
    prior = float(y.mean()) if len(y) else 0.5
    lengths = np.diff(first)
    line_y = np.repeat(y, lengths)
    weight = np.repeat(1 / np.maximum(lengths, 1), lengths)
    inner = np.ones(len(x), bool)
    inner[first[:-1][lengths > 0]] = False
    at = np.flatnonzero(inner)
    theta = np.zeros(x.shape[1] + 4)
    moment, square = np.zeros_like(theta), np.zeros_like(theta)
    seen = np.zeros((2, 2))
    np.add.at(seen, (line_y[at - 1].astype(int), line_y[at].astype(int)), weight[at])
    for step in range(1, rounds + 1):
        w, changes = theta[:-4], theta[-4:].reshape(2, 2)
        score = x @ w
        forward, backward = _chains(score, changes, first)
        both = forward + backward
        total = np.logaddexp(both[:, 0], both[:, 1])
        good = np.exp(both[:, 1] - total)
        grad_w = x.T @ (weight * (line_y - good))
        unary = np.stack([np.zeros(len(x)), score], 1)
        pair = forward[at - 1][:, :, None] + changes[None] + (unary + backward)[at][:, None, :] - total[at][:, None, None]
        grad = np.concatenate([grad_w, (seen - (weight[at][:, None, None] * np.exp(pair)).sum(0)).ravel()]) - l2 * theta
        grad /= max(len(y), 1)
        moment = 0.9 * moment + 0.1 * grad
        square = 0.99 * square + 0.01 * grad * grad
        theta = theta + rate * (moment / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.99 ** step)) + 1e-8)
    return Field(theta[:-4], theta[-4:].reshape(2, 2), prior)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, stop, data, offsets in T.slices(batch.column(1)):
            own, _, first = line_features(data, offsets)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).slice(row, stop - row) for c in (0, 2)] + [pa.array([own[first[k]:first[k + 1]].astype("<f4").tobytes() for k in range(stop - row)], pa.binary())],
                ["doc_id", "quality", "lines"])


def fit_labels(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> Field:
    """Fit on at most ``max_docs`` labelled documents, those whose doc_id has the smallest hash."""
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    sample = known.join(docs.select("doc_id").where("doc_id IS NOT NULL").distinct(), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    rows = docs.select("doc_id", "text").join(sample, "doc_id").select("doc_id", "text", "quality").mapInArrow(
        _lines, "doc_id bigint, quality int, lines binary").dropDuplicates(["doc_id"]).collect()
    rows.sort(key=lambda r: r.doc_id)
    own = [np.frombuffer(r.lines, "<f4").reshape(-1, len(OWN)).astype(float) for r in rows]
    first = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64)
    x = np.concatenate(own) if own else np.zeros((0, len(OWN)))
    return fit(with_neighbours(x, first), first, np.array([r.quality for r in rows], float))


def score_documents(docs: DataFrame, field: Field) -> DataFrame:
    """``(doc_id, score, n_lines, good_lines)`` for every row of ``docs(doc_id, text)``.

    A text without a word (null, empty, white space) has no line and gets the training share of
    good documents. Repeated rows are all returned; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, stop, data, offsets in T.slices(batch.column(1)):
                own, words, first = line_features(data, offsets)
                good = marginals(field, with_neighbours(own, first), first)
                cum = np.concatenate([[0], np.cumsum(good * words)])
                total = np.concatenate([[0], np.cumsum(words)])
                n = total[first[1:]] - total[first[:-1]]
                score = np.where(n > 0, np.clip((cum[first[1:]] - cum[first[:-1]]) / np.maximum(n, 1), 0, 1), field.prior)
                kept = np.concatenate([[0], np.cumsum(good >= 0.5)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, stop - row), pa.array(score), pa.array(np.diff(first).astype(np.int64)), pa.array((kept[first[1:]] - kept[first[:-1]]).astype(np.int64))],
                    ["doc_id", "score", "n_lines", "good_lines"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double, n_lines bigint, good_lines bigint")


def held_out(doc_id: str = "doc_id", remainder: int = 0):
    """Whether crc32 of the id as text leaves ``remainder`` modulo 5; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == remainder, F.lit(False))


def line_quality(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, bound: float = 0.3) -> DataFrame:
    """Scores of all documents by a field that saw no label of the held-out ones."""
    field = fit_labels(docs, labels.where(~held_out()), max_docs)
    return score_documents(docs, field).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= bound).cast("int").alias("predicted"), "n_lines", "good_lines")
