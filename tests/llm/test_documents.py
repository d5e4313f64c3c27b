"""Near duplicates, quality rules, packing and mixing against plain versions."""

import random
import tracemalloc
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stratamart.llm import minhash, mixing, packing, quality_rules
from stratamart.llm.mixing import mixed_documents, source_targets

DOC = "doc_id bigint, text string"


def keyed(df, key, *cols):
    return {r[key]: tuple(r[c] for c in cols) for r in df.collect() if r[key] is not None}


def test_near_duplicates(spark, documents, texts):
    found = keyed(minhash.near_duplicates(documents), "doc_id", "n_shingles", "component_id", "kept")
    plain = brute.near_duplicates(texts)
    assert found == {i: (n, c, i == c) for i, (n, c) in plain.items()}
    assert len({c for _, c in plain.values()}) < len(texts)


def near_group(n, seed=5):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    rows = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.randrange(7)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    return rows


def test_near_group_in_blocks(spark, monkeypatch):
    rows = near_group(250)
    monkeypatch.setattr(minhash, "BLOCK", 16)
    found = keyed(minhash.near_duplicates(spark.createDataFrame(rows, DOC)), "doc_id", "component_id")
    assert found == {i: (c,) for i, (_, c) in brute.near_duplicates(dict(rows)).items()}


def test_near_duplicates_tricky(spark, tricky):
    rows = minhash.near_duplicates(tricky).collect()
    assert len(rows) == tricky.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[0].n_shingles == by_id[2].n_shingles == 0 and by_id[1].component_id == 1
    assert by_id[None].component_id is None and by_id[None].kept
    assert minhash.near_duplicates(tricky.limit(0)).count() == 0


def test_rule_counts(spark, documents, texts, tricky):
    for df in (documents, tricky):
        for r in quality_rules.document_statistics(df).join(df, "doc_id").select(*quality_rules.COUNTS, "text").collect():
            assert tuple(r)[:5] == brute.rule_counts(r.text), r.text


def test_rules_keep_good(spark, documents, small):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    judged = quality_rules.quality_rules(documents, labels).join(labels, "doc_id").where("NOT base_failed").select("kept", "quality").collect()
    assert np.mean([r.kept for r in judged if r.quality == 1]) > 0.97
    assert quality_rules.quality_rules(documents.limit(0), labels.limit(0)).count() == 0


def test_trees_are_monotonic():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 2))
    y = (x[:, 0] + 0.3 * np.sin(9 * x[:, 0]) + 0.2 * rng.standard_normal(2000) > 0.5).astype(float)
    trees = quality_rules.fit(x, y, [1, 0])
    grid = np.stack([np.linspace(0, 1, 200), np.full(200, 0.4)], 1)
    score = trees.score(grid)
    assert (np.diff(score) >= -1e-12).all() and score[-1] - score[0] > 0.5


def test_tokens_equal_the_tokenizer(texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    import pyarrow as pa

    from stratamart.llm.text import slices

    own = packing.WordTokens(path)
    from tricky_texts import TRICKY

    sample = [t or "" for t in [*list(texts.values())[:200], *TRICKY, "it's they'll <|endoftext|> x<|startoftext|>y ́a\x85b", "A.,, b!!'s c's'. ok<|EndOfText|>. ABC<|endoftext|>,",
                                            "H̱a, Éa... 3.5% 12, x\u0338. a\u0338, Ünder- ×, a×. ǅ. İ, ſ. word... ... .. a,b,c,, ,x ((y)) 日本。, a" + "." * 12]]
    for row, _, data, offsets in slices(pa.array(sample)):
        ids, bounds = own.encode(data, offsets)
        for k in range(len(offsets) - 1):
            assert ids[bounds[k]:bounds[k + 1]].tolist() == plain.encode(sample[row + k], add_special_tokens=False).ids


def test_parts_of_letters_need_the_model_alone():
    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    own = packing.WordTokens(path)
    given = []

    class Recorder:
        def __getattr__(self, name):
            return lambda parts, **options: given.append(parts) or getattr(plain, name)(parts, **options)

    own.tokenizer = Recorder()
    letters = "".join(chr(c) for c in [*range(65, 91), *range(97, 123), *range(0xC0, 0x100)] if c not in (0xD7, 0xF7))
    text = " ".join([*letters, letters, "ÀÉÎÕÜ naïve ÞÆ ßtraße ÿ", "WORD Word word"])
    data = np.frombuffer(text.encode(), np.uint8)
    ids, bounds = own.encode(data, np.array([0, len(data)]))
    assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids and bounds.tolist() == [0, len(ids)]
    assert not given


@pytest.mark.parametrize("kept", [50, 700_000])
def test_tokens_stay_right_as_the_cache_grows_and_is_cleared(monkeypatch, kept):
    monkeypatch.setattr(packing, "CACHED_WORDS", kept)
    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    own = packing.WordTokens(path)
    rng = np.random.default_rng(1)
    for count in (0, 30, 30, 40_000, 20, 60_000):
        words = ["".join(x) + "., é4"[k % 6:] for k, x in enumerate(rng.choice(list("abcdeé"), (count, 7)))]
        texts = [" ".join(words[k:k + 500]) for k in range(0, count, 500)] or [""]
        raw = [t.encode() for t in texts]
        ids, bounds = own.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        for k, found in enumerate(plain.encode_batch_fast(texts, add_special_tokens=False)):
            assert ids[bounds[k]:bounds[k + 1]].tolist() == found.ids


def test_least_squares_meet_the_conditions_of_a_minimum():
    rng = np.random.default_rng(2)
    rows, values = rng.integers(0, 30, (200, 3)), rng.choice([0.0, 0.5, 1.0], (200, 3))
    a = np.zeros((30, 200))
    for k in range(200):
        np.add.at(a[:, k], rows[k], values[k])
    b = a @ np.maximum(rng.normal(size=200), 0) + rng.normal(size=30)
    x = packing.nnls(rows, values, b, rounds=600)
    gain = a.T @ (b - a @ x)
    assert (x >= 0).all() and gain.max() < 1e-6 and np.abs(gain[x > 0]).max() < 1e-6


def test_plan_lays_out_no_table_of_all_patterns():
    histogram = {n: 1 + n * 7919 % 50 for n in range(1, 4097)}
    tracemalloc.start()
    try:
        _, sequences = packing.plan(histogram)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sequences <= 1.02 * -(-sum(n * c for n, c in histogram.items()) // 4096) + 1
    assert peak < 64e6


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    lengths = np.clip(rng.lognormal(6, 1.2, [0, 50, 3000, 40000][seed]).astype(int), 1, 4096)
    histogram = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
    places, sequences = packing.plan(histogram)
    used = np.zeros((sequences, 2), np.int64)
    spans = []
    for n, segments in places.items():
        assert sum(s[1] for s in segments) == histogram[n]
        rank = 0
        for first, count, sequence, offset in segments:
            assert first == rank
            rank += count
            spans += [(sequence + k, offset, n) for k in range(count)]
    at = dict.fromkeys(range(sequences), 0)
    for sequence, offset, n in sorted(spans):
        assert at[sequence] == offset  # gapless from 0
        at[sequence] += n
    assert all(0 < v <= 4096 for v in at.values())
    if seed >= 2:
        assert sequences <= 1.02 * -(-int(lengths.sum()) // 4096) + 1
    del used


def test_packing(spark, documents, texts, tricky):
    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    for df in (documents, tricky, tricky.limit(0)):
        rows = packing.pack(packing.pieces(df, path)).collect()
        end = {}
        for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
            assert r.offset == end.get(r.sequence_id, 0)
            end[r.sequence_id] = r.offset + r.length
            assert end[r.sequence_id] <= 4096
        if df is documents:
            for r in rows[:100]:
                ids = [*plain.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 1][r.start:r.start + r.length]
                assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes()) and len(ids) == r.length


def test_targets():
    assert source_targets({"a": 10, "b": 100}, {"a": 3, "b": 1}, 165, 2) == {"a": 20.0, "b": 145.0}
    assert source_targets({"a": 0}, {"a": 1}, 0, 2) == {"a": 0.0}


def test_mixing(spark, documents, texts, tricky):
    for df in (documents, tricky, tricky.limit(0)):
        rows = mixed_documents(df).collect()
        assert len(rows) == df.count()
        assert all(0 <= r.taken <= 2 * r["size"] for r in rows)
        totals = {}
        for r, s in ((r, r.source_size) for r in rows):
            totals.setdefault((s, r.target), []).append(r.taken)
        for (size, target), taken in totals.items():
            assert abs(sum(taken) - target) <= 1 or size is None
        assert sorted(map(str, mixed_documents(df).collect())) == sorted(map(str, rows))
    sizes = {i: len(brute.WORD.findall(t or "")) for i, t in texts.items()}
    assert {r.doc_id: r["size"] for r in mixed_documents(documents).collect()} == sizes


@pytest.mark.parametrize("ranges", [1, 7])
def test_cut_time(spark, ranges):
    rng = random.Random(9)
    target = {"a": 70.5, "b": 11.25, None: 300.0, "d": 1.5}
    rows, totals = [], {}
    for source, rate in target.items():
        upto = 0
        for _ in range(40):
            size = rng.randrange(1, 30)
            upto += size
            rows.append((source, size, rate, upto))
        totals[source] = upto
    copies = spark.createDataFrame(rows, "source string, size long, target double, upto long")
    for budget in (0.0, 5.0, 383.25, 1000.0, 0.9 * sum(totals.values())):
        cut = mixing.cut_time(copies, budget, ranges)
        assert sum(min(cut * target[s], totals[s]) for s in target) == pytest.approx(budget, abs=1e-3)
    last = max(totals[s] / target[s] for s in target)
    assert mixing.cut_time(copies, 2.0 * sum(totals.values()), ranges) == pytest.approx(last)
    assert mixing.cut_time(copies.limit(0), 5.0, ranges) is None


def test_mix_is_cut_in_the_order_of_all_sources(spark, monkeypatch):
    rows = [(k, f"s{k % 3}", 10 + k % 7) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long")
    seen, cut_time = [], mixing.cut_time
    monkeypatch.setattr(mixing, "cut_time", lambda *x: seen.append(cut_time(*x)) or seen[-1] / 2)
    monkeypatch.setattr(mixing, "RANGE_ROWS", 50)
    words = sum(r[2] for r in rows)
    found = {r.source: (r.target, r.taken) for r in mixing.mix(docs).groupBy("source").agg(
        F.max("target").alias("target"), F.sum("taken").alias("taken")).collect()}
    assert seen == [pytest.approx(1)] and sum(t for t, _ in found.values()) == pytest.approx(1.5 * words)
    assert all(abs(taken - target / 2) <= 1 for target, taken in found.values())
