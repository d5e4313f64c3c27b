"""Language-model scores: interpolated modified Kneser-Ney over word pairs.

Counting is one shuffle of packed arrays: tasks count the pairs of their texts and send, for each
shard of the first word, one sorted array; a shard's task adds them up. Shards are as many as the
corpus needs for about ``SHARD_BYTES`` of text each. Every shard is stored in the shared folder as
sorted hash arrays (pairs, and per first word the sums that its discounts need); the words seen
after each other word are stored the same way. Scoring tasks memory-map the arrays and look the
distinct pairs of a slice of text up in them, sorted.

With counts ``c``, ``S(v)`` the pairs after ``v`` and ``D(c)`` the discount of a count (one each for
1, 2 and 3 or more, from the counts of counts of its order):

    P(w | v) = max(c(v,w) - D(c(v,w)), 0) / S(v) + g(v) P(w)          P(w) alone where v is new
    P(w)     = max(k(w) - D(k(w)), 0) / K + g / (V + 1)               k(w): words w was seen after
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratamart.llm import text as T
from stratamart.llm.arrays import Arrays, local_path, packed, runs, shard_of, store, summed
from stratamart.session import scratch_path, stable

SHARD_BYTES = 16 << 20
TASK_TOKENS = 1_000_000
BEGIN, END = np.int64(1), np.int64(2)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the tokens and of the tokens before them, and each text's first token; every text
    ends with an end token and begins after a begin mark."""
    data = T.lower(data)
    starts, ends, first = T.word_spans(data, offsets)
    words = T.span_hash(T.prefix_hash(data), starts, ends).view(np.int64)
    bounds = first + np.arange(len(first))
    now = np.insert(words, first[1:], END)
    before = np.empty_like(now)
    before[1:] = now[:-1]
    before[bounds[:-1]] = BEGIN
    return now, before, bounds


def pair_hash(before: np.ndarray, now: np.ndarray) -> np.ndarray:
    return T.mix(before.view(np.uint64) * np.uint64(0x9FB21C651E98DF25) + T.mix(now.view(np.uint64))).view(np.int64)


def _count_pairs(shards: int):
    """Rows ``(shard, first words, their numbers of pairs, second words, counts)``."""

    def flush(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        before, now = (np.concatenate(x) for x in zip(*held, strict=True))
        _, where, (counts,) = summed(pair_hash(before, now), np.ones(len(now), np.int64))
        before, now = before[where], now[where]
        order = np.argsort(before, kind="stable")
        before, now, counts = before[order], now[order], counts[order]
        shard = shard_of(before, shards)
        order = np.argsort(shard, kind="stable")
        shard = shard[order]
        rows = []
        for s, e in runs(shard):
            at = order[s:e]
            v = before[at]
            head = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
            rows.append((int(shard[s]), v[head].tobytes(), np.diff(np.append(head, len(v))).astype(np.int32).tobytes(), now[at].tobytes(), counts[at].astype(np.int32).tobytes()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), *[pa.binary()] * 4), strict=True)], ["shard", "firsts", "runs", "seconds", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for _, _, data, offsets in T.slices(batch.column(0)):
                now, before, _ = tokens(data, offsets)
                held.append((before, now))
                size += len(now)
                if size >= TASK_TOKENS:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    return run


def _of_counts(values: np.ndarray) -> list[int]:
    return [int((values == k).sum()) for k in (1, 2, 3, 4)]


def _reduce_pairs(folder: str, shards: int):
    """Add a shard's arrays up and store them; gives the counts of its second words by shard."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        shard = int(group["shard"].iloc[0])
        first = np.concatenate([np.repeat(np.frombuffer(a, np.int64), np.frombuffer(n, np.int32)) for a, n in zip(group["firsts"], group["runs"], strict=True)])
        second = np.frombuffer(b"".join(group["seconds"]), np.int64)
        keys, where, (counts,) = summed(pair_hash(first, second), np.frombuffer(b"".join(group["counts"]), np.int32))
        first, second = first[where], second[where]
        store(folder, f"pair-{shard}", keys)
        store(folder, f"pair-count-{shard}", np.minimum(counts, 0xFFFFFFFF).astype(np.uint32))
        words, _, sums = summed(first, counts, counts == 1, counts == 2, counts >= 3)
        store(folder, f"first-{shard}", words)
        store(folder, f"first-sums-{shard}", np.stack(sums, 1))
        low, _, (total, kinds) = summed(second, counts, np.ones(len(second), np.int64))
        rows = [(s, *parts, [0] * 4) for s, parts in packed(shard_of(low, shards), [low, total, kinds])]
        rows.append((-1, b"", b"", b"", _of_counts(counts)))
        return pd.DataFrame(rows, columns=["shard", "words", "totals", "kinds", "of_counts"])

    return run


def _reduce_words(folder: str):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        shard = int(group["shard"].iloc[0])
        words, _, (total, kinds) = summed(*(np.frombuffer(b"".join(group[c]), np.int64) for c in ("words", "totals", "kinds")))
        store(folder, f"word-{shard}", words)
        store(folder, f"word-counts-{shard}", np.stack([total, kinds], 1))
        return pd.DataFrame([(len(words), int(total.sum()), int(kinds.sum()), [*_of_counts(kinds), int((kinds >= 3).sum())])], columns=["v", "n", "k", "of_counts"])

    return run


def discounts(of_counts: list[int]) -> tuple[float, float, float]:
    """The discounts of counts 1, 2 and 3 or more; where the counts of counts give none between 0
    and the count, those of plain absolute discounting."""
    n1, n2, n3, n4 = of_counts[:4]
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    out = []
    for k, (low, high) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1):
        d = k - (k + 1) * y * high / low if low else y
        out.append(d if 0 < d < k else y)
    return out[0], out[1], out[2]


@dataclass(frozen=True)
class Model:
    """Where the arrays are, and the numbers that hold for all of them."""

    folder: str
    shards: int
    words: int  # V
    tokens: int  # N
    kinds: int  # K, distinct pairs
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    word_rest: float  # what the discounts of P(w) leave to the uniform part


def train(texts: DataFrame, shard_bytes: int = SHARD_BYTES) -> Model:
    """Count and store the model of ``texts(text)``; a null text is an empty one."""
    spark = texts.sparkSession
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    folder = scratch_path(spark, "ngram")
    local = local_path(folder)
    pairs = texts.select("text").mapInArrow(_count_pairs(shards), "shard bigint, firsts binary, runs binary, seconds binary, counts binary")
    low = stable(pairs.groupBy("shard").applyInPandas(
        _reduce_pairs(local, shards), "shard bigint, words binary, totals binary, kinds binary, of_counts array<bigint>"))
    sums = low.where("shard < 0").select(*[F.sum(F.col("of_counts")[k]) for k in range(4)]).first()
    counted = low.where("shard >= 0").groupBy("shard").applyInPandas(_reduce_words(local), "v bigint, n bigint, k bigint, of_counts array<bigint>")
    v, n, k, *of = [x or 0 for x in counted.select(F.sum("v"), F.sum("n"), F.sum("k"), *[F.sum(F.col("of_counts")[i]) for i in range(5)]).first()]
    word_discounts = discounts(of[:4])
    rest = (word_discounts[0] * of[0] + word_discounts[1] * of[1] + word_discounts[2] * of[4]) / k if k else 1.0
    return Model(local, shards, v, n, k, discounts([x or 0 for x in sums]), word_discounts, rest)


def _look(arrays: Arrays, keys: str, values: str, shard: np.ndarray, wanted: np.ndarray, width: int) -> np.ndarray:
    """The values of the wanted keys, 0 where there are none."""
    out = np.zeros((len(wanted), width), np.int64)
    for number, at, place in arrays.places(keys, shard, wanted):
        out[at] = arrays.array(f"{values}-{number}")[place].reshape(-1, width)
    return out


def _discounted(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(counts - np.array([0.0, *d])[np.minimum(counts, 3)], 0)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, n_tokens, n_known, train_tokens, base_score, score, ...)`` for every row of
    ``docs(doc_id, text, held_out)``: sums of log10 probabilities, and the perplexity per token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = Arrays(model.folder)
        for batch in batches:
            for row, stop, data, offsets in T.slices(batch.column(1)):
                now, before, bounds = tokens(data, offsets)
                words, which = np.unique(now, return_inverse=True)
                found = _look(arrays, "word", "word-counts", shard_of(words, model.shards), words, 2)
                base = np.log10((found[:, 0] + 0.5) / (model.tokens + 0.5 * (model.words + 1)))[which]
                plain = _discounted(found[:, 1], model.word_discounts) / max(model.kinds, 1) + model.word_rest / (model.words + 1)
                pairs, where, of = np.unique(pair_hash(before, now), return_index=True, return_inverse=True)
                firsts, first_of = np.unique(before[where], return_inverse=True)
                sums = _look(arrays, "first", "first-sums", shard_of(firsts, model.shards), firsts, 4)[first_of]
                counts = _look(arrays, "pair", "pair-count", shard_of(before[where], model.shards), pairs, 1)[:, 0]
                seen = np.maximum(sums[:, 0], 1)
                rest = np.where(sums[:, 0] > 0, (sums[:, 1:] @ np.array(model.pair_discounts)) / seen, 1.0)
                chance = np.log10(_discounted(counts, model.pair_discounts) / seen + rest * plain[which][where])[of]
                known = np.concatenate([[0], np.cumsum((found[:, 0] > 0)[which])])
                n = np.diff(bounds)
                sums_of = [np.add.reduceat(x, bounds[:-1]) for x in (base, chance)]  # every text has its end token
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(row, stop - row), batch.column(2).slice(row, stop - row), pa.array(n.astype(np.int64)),
                    pa.array((known[bounds[1:]] - known[bounds[:-1]]).astype(np.int64)), pa.array(np.full(stop - row, model.tokens, np.int64)),
                    pa.array(sums_of[0]), pa.array(sums_of[1]), pa.array(10.0 ** np.minimum(-sums_of[1] / n, 300))],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    return docs.select("doc_id", "text", "held_out").mapInArrow(
        run, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, perplexity double")


def language_model_scores(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Score all rows of ``docs(doc_id, text)`` by a model of those not held out.

    Held out are the ids whose crc32 as text leaves 1 modulo 5 (never a null id). A null or empty
    text is one end token; repeated rows count and are returned each; other columns are not read.
    Without training rows the base and the model are uniform.
    """
    marked = docs.select("doc_id", "text", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False)).alias("held_out"))
    return score(marked, train(marked.where("NOT held_out"), shard_bytes))
