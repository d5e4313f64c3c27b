"""The corpus pipeline, stage by stage, against plain versions."""

import brute
import pyarrow as pa
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from stratamart.llm import minhash, suffix_dedup
from stratamart.llm.stages import STAGE_PERCENT
from stratamart.llm.text import slices
from stratamart.session import stable


@pytest.fixture(scope="module")
def stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stable(stage(spark, out[-1], small)))
    return out


def test_stages_return_documents(stages):
    for df in stages[1:-1]:
        assert df.dtypes == stages[0].dtypes and df.count() > 0


def by_id(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_rules_and_dedup(stages):
    given, ruled, single = (by_id(df) for df in stages[:3])
    for i, text in given.items():
        n, *_, repeats = brute.rule_counts(text)
        if n < 10 or 100 * repeats > 20 * n:
            assert i not in ruled
    assert all(given[i] == t for i, t in ruled.items()) and len(ruled) > 0.7 * len(given)
    plain = brute.near_duplicates(ruled, STAGE_PERCENT)
    assert single == {i: ruled[i] for i, (_, c) in plain.items() if i == c}


def test_dedup_takes_similarity_of_80_percent(spark, small):
    words = [f"a{k}" for k in range(104)]  # 100 shingles
    # sets of 100 shingles that share s and differ in 100 - s: s / (200 - s) is 0.786, 0.818, 0.852
    rows = [(g * 10 + k, " ".join(f"g{g}{w}" if not k or i < s + 4 else f"z{g}{w}" for i, w in enumerate(words)), "en", "s", 1)
            for g, s in enumerate((88, 90, 92), 1) for k in range(2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    from stratamart.llm.minhash import Similarity, near_duplicates

    assert sorted(by_id(corpus_pipeline.dedup_stage(spark, docs, small))) == [10, 11, 20, 30]
    assert sorted(r.doc_id for r in near_duplicates(docs).where("kept").collect()) == [10, 11, 20, 21, 30]
    assert (Similarity().matches, Similarity().threshold) == (17, 90)


def test_dedup_of_ids_that_repeat_with_other_texts(spark, small):
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(3, b), (7, a), (7, b), (10, c), (10, a), (11, c + " more"), (None, a), (None, "words of its own only"), (12, ""), (12, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = sorted(((r.doc_id, r.text) for r in corpus_pipeline.dedup_stage(spark, docs, small).collect()), key=repr)
    assert kept == sorted([(3, b), (7, a), (10, c), (None, "words of its own only"), (12, ""), (12, None)], key=repr)


def test_dedup_against_plain_pairs(stages):
    ruled, single = by_id(stages[1]), by_id(stages[2])
    sets = {i: s for i, t in ruled.items() if (s := brute.shingle_set(t))}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert single == {i: ruled[i] for i, c in brute.components(ruled, links).items() if i == c}


def test_passages(stages):
    single, cut = by_id(stages[2]), by_id(stages[3])
    covered = brute.repeated_bytes(single)
    for i, text in single.items():
        gone = set(covered[i])
        kept = bytes(b for k, b in enumerate(text.encode()) if k not in gone).decode("utf-8", "ignore")
        assert cut.get(i, "") == (kept if brute.WORD.search(kept) else "")


def test_mixing(stages):
    cut, mixed = stages[3], stages[4].collect()
    sizes, sources = {}, {}
    for r in cut.collect():
        sizes[r.doc_id] = len(brute.WORD.findall(r.text))
        sources[r.source] = sources.get(r.source, 0) + sizes[r.doc_id]
    weights = dict(zip(sorted(sources), [3, 1, 2] * len(sources)))
    target, left, free = {}, 1.5 * sum(sources.values()), set(sources)
    while free:
        share = {s: left * weights[s] / sum(weights[k] for k in free) for s in free}
        full = {s for s in free if share[s] > 2 * sources[s]}
        for s in full or free:
            target[s] = 2 * sources[s] if full else share[s]
            left -= target[s]
        free -= full or free
    taken = {}
    for r in mixed:
        taken[r.source] = taken.get(r.source, 0) + len(brute.WORD.findall(r.text))
        assert r.n_chars == len(r.text)
    assert all(abs(taken.get(s, 0) - target[s]) <= 1 for s in target)


def test_rows_without_id(spark, small):
    good = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    given = [(i, t, "en", "s", len(t)) for i, t in list(good.items())[:60]]
    kept = by_id(corpus_pipeline.STAGES[0][1](spark, spark.createDataFrame(given, schema), small))
    nameless = [(None, *r[1:]) for r in given]
    ruled = corpus_pipeline.STAGES[0][1](spark, spark.createDataFrame(nameless, schema), small)
    assert {r.text for r in ruled.collect()} <= {t for t in good.values() if (c := brute.rule_counts(t))[0] >= 10 and 100 * c[4] <= 20 * c[0]} and kept
    # 2 sources of 3 and 1: targets of the first are its two epochs, the second is cut
    docs = [(None if k % 2 else k, f"  \t{k} " + "word " * 19, "en", f"s{k % 4 // 2}", 0) for k in range(40)]
    mixed = corpus_pipeline.STAGES[3][1](spark, spark.createDataFrame(docs, schema), small).collect()
    words = {s: sum(len(brute.WORD.findall(r.text)) for r in mixed if r.source == s) for s in ("s0", "s1")}
    assert words == {"s0": 800, "s1": 400} and any(r.doc_id is None for r in mixed)


def test_cut_text_keeps_every_taken_word(spark, small):
    docs = [(k, " \n" + " ".join(f"w{k}x{j}" for j in range(7)), "en", s, 0) for s, k in (("a", 1), ("b", 2), ("c", 3))]
    mixed = corpus_pipeline.STAGES[3][1](spark, spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint"), small).collect()
    # 31.5 words by 3, 1, 2: two epochs of the first are 14; the others share 17.5 by 1 and 2
    taken = {s: sum(len(brute.WORD.findall(r.text)) for r in mixed if r.source == s) for s in "abc"}
    assert taken == {"a": 14, "b": 6, "c": 12}


def test_packing(stages):
    end = {}
    for r in sorted(stages[5].collect(), key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == end.get(r.sequence_id, 0)
        end[r.sequence_id] = r.offset + r.length
    assert all(n <= 4096 for n in end.values())


def test_run_is_registered(spark, small, stages):
    assert entry.queries()["pipeline"](spark, small).count() == stages[-1].count()


def test_empty_and_odd_documents(spark, tricky, small):
    docs = tricky.select("doc_id", "text", "lang", "source", tricky["n_chars"].cast("bigint"))
    for given in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            given = stable(stage(spark, given, small))
        assert given.count() >= 0
    assert suffix_dedup.without_repeats(docs).columns == docs.columns


def test_workers_hold_arrays_of_short_runs(monkeypatch):
    """Worker memory follows the text that is hashed at once, so that is bounded in both deduplicating stages."""
    held, prefix_hash = [], minhash.T.prefix_hash
    monkeypatch.setattr(minhash.T, "prefix_hash", lambda data: held.append(len(data)) or prefix_hash(data))
    texts = pa.array([f"{k} " + "some words " * 900 for k in range(400)])
    assert sum(stop - row for row, stop, _, _ in minhash.shingles(texts)) == 400
    for _, _, data, offsets in slices(texts):
        suffix_dedup.Fragments(data, offsets)
    assert sum(held) == 2 * sum(len(t) for t in texts.to_pylist()) and max(held) <= 512 << 10
