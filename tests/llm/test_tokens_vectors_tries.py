"""Byte-level BPE, whitening and prefix tries against plain versions."""

from __future__ import annotations

import base64
import hashlib
import random

import brute
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tricky_texts import TRICKY

import __spark_entry__ as entry
from stratamart.llm import byte_bpe, prefix_trie, whitening
from stratamart.llm import text as T
from stratamart.llm.queries import RANKS


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.ByteBpe(RANKS)


@pytest.fixture(scope="module")
def plain():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded(bpe, texts):
    """Ids and offsets of each text, all encoded together."""
    data = "".join(texts).encode()
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    ids, begins, bounds = bpe.encode(np.frombuffer(data, np.uint8), offsets)
    return [(ids[s:e].tolist(), begins[s:e].tolist()) for s, e in zip(bounds, bounds[1:], strict=False)]


def same(bpe, plain, texts):
    for text, (ids, begins) in zip(texts, encoded(bpe, texts), strict=True):
        assert ids == plain.encode_ordinary(text), text[:80]
        sizes = [len(plain.decode_single_token_bytes(i)) for i in ids]
        assert begins == np.cumsum([0, *sizes])[:-1].tolist()
        assert bpe.decode(np.array(ids, np.uint32)).tobytes() == text.encode()


def test_slices_and_merges_as_the_library(bpe, plain):
    dealt = random.Random(5)
    odd = "  \n\t''''sstmdrevell LaéßÉ09 5² \u0085 　中文!?#-\x1c\x1f​😀'll'S"
    same(bpe, plain, [t for t in TRICKY if t] + ["", "it's we'll 'tis ''s 's's' x'sab'", " 's", "\n's", "<|endoftext|>"])
    same(bpe, plain, ["".join(dealt.choice(odd) for _ in range(dealt.randint(0, 30))) for _ in range(20_000)])
    same(bpe, plain, ["".join(chr(c) for c in (dealt.randrange(0x110000) for _ in range(25)) if not 0xD800 <= c < 0xE000) for _ in range(500)])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=6))
def test_any_text(bpe, plain, texts):
    same(bpe, plain, texts)


def test_long_slices_and_long_texts(bpe, plain, monkeypatch):
    same(bpe, plain, ["x" * 3000, "ab" * 700 + "é" * 500, "#" * 1000, " " * 900 + "x" + "\n" * 70])
    monkeypatch.setattr(byte_bpe, "SLICE_BYTES", 50)
    dealt = random.Random(8)
    for _ in range(60):
        text = "".join(dealt.choice("ab 'st  \nçx") for _ in range(dealt.randint(101, 900)))
        same(bpe, plain, [text])
    same(bpe, plain, ["z" * 400 + " y" + "w" * 300])


def test_a_full_cache_changes_nothing(plain, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHED_SLICES", 40)
    small = byte_bpe.ByteBpe(RANKS)
    for k in range(5):
        same(small, plain, [f"a{k} few words{k} of their own {i}" for i in range(10)])


def test_bpe_query_over_documents(spark, small, texts, plain):
    got = {r.doc_id: r for r in entry.queries()["op11_byte_bpe"](spark, small).collect()}
    assert len(got) == len(texts)
    for i, text in texts.items():
        ids = np.array(plain.encode_ordinary(text or ""), "<u4")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (
            len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())


def test_bpe_of_odd_rows(spark, tricky, plain):
    docs = tricky.withColumnsRenamed({"key": "ids", "rep": "offsets", "hashes": "decoded"})
    rows = byte_bpe.decode(byte_bpe.encode(docs, RANKS), RANKS).collect()
    want = sorted(((r.doc_id, (r.text or "").encode()) for r in docs.collect()), key=repr)
    assert sorted(((r.doc_id, bytes(r.decoded)) for r in rows), key=repr) == want
    assert all(len(r.offsets) == 2 * len(r.ids) for r in rows)
    assert byte_bpe.decode(byte_bpe.encode(docs.limit(0), RANKS), RANKS).collect() == []
    given = spark.createDataFrame([(1, None), (2, bytearray()), (3, bytearray(np.array([257], "<u4").tobytes()))], "x int, ids binary")
    got = [r.decoded for r in byte_bpe.decode(given, RANKS).orderBy("x").collect()]
    assert got[0] is None and bytes(got[1]) == b"" and bytes(got[2]) == plain.decode_single_token_bytes(257)


# --- whitening -----------------------------------------------------------------------------------


def plain_whitening(vectors, components=32):
    """Values, vectors, whitened rows and deviations of whole ``vectors`` by numpy."""
    x = np.floor(64 * np.array(vectors, np.float64)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    wide = n * x.astype(object) - sums.astype(object)
    centred = wide.astype(np.float64) / n
    cov = centred.T @ centred / n
    values, found = np.linalg.eigh(cov)
    values, found = values[::-1][:components], found[:, ::-1][:, :components]
    return values, found, centred @ found / np.sqrt(np.maximum(values, 1e-300)), [int((r * r).sum()) for r in wide], np.trace(cov)


def test_whitening_of_the_table(spark, small):
    given = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    values, _, whitened, deviations, trace = plain_whitening([v for _, v in given])
    row = {i: k for k, (i, _) in enumerate(given)}
    got = entry.queries()["op12_whitening"](spark, small).collect()
    assert len(got) == 32 * len(given)
    out = np.zeros_like(whitened)
    for r in got:
        k, c = row[r.vec_id], r.component - 1
        out[k, c] = r.whitened
        assert (r.n, r.deviation) == (len(given), deviations[k]) and r.identity_error < 1e-9
        assert abs(r.explained - values[c] / trace) <= 1e-9 * r.explained
    signs = np.sign((out * whitened).sum(axis=0))
    assert np.abs(out * signs - whitened).max() < 1e-8


def test_whitening_of_odd_rows(spark):
    dealt = np.random.default_rng(3)
    whole = dealt.normal(size=(40, 5)).astype(np.float32)
    rows = [(i, [float(x) for x in v], 1, 2.0) for i, v in enumerate(whole)]
    rows += [(3, rows[3][1], 1, 2.0), (None, rows[4][1], 1, 2.0)]  # repeated and nameless rows count
    odd = [(100, None, 1, 2.0), (101, [1.0, None, 0.0, 0.0, 0.0], 1, 2.0), (102, [float("nan")] * 5, 1, 2.0), (103, [float("inf"), 0.0, 0.0, 0.0, 0.0], 1, 2.0),
           (104, [1.0, 2.0], 1, 2.0), (105, [], 1, 2.0)]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>, n int, whitened double").repartition(5)
    model = whitening.fit_whitening(df)
    got = whitening.whiten(df, model).collect()
    values, _, whitened, deviations, _ = plain_whitening([r[1] for r in rows])
    assert len(got) == 5 * len(rows) and {r.vec_id for r in got} == {r[0] for r in rows}
    assert np.allclose(model.values, values, rtol=1e-12) and model.identity_error < 1e-9
    assert sorted(r.deviation for r in got if r.component == 1) == sorted(deviations)
    for given in (df.limit(0), df.where("vec_id = 100")):
        assert whitening.whiten(given, whitening.fit_whitening(given)).collect() == []


def test_whitening_without_variance(spark):
    df = spark.createDataFrame([(i, [1.0, float(i % 3), 7.0, 2.0 * (i % 3)]) for i in range(9)], "vec_id bigint, embedding array<double>")
    got = whitening.whiten(df, whitening.fit_whitening(df)).collect()  # one direction varies
    assert all((r.whitened is None) == (r.component > 1) and abs(r.explained - (r.component == 1)) < 1e-12 for r in got) and len(got) == 36
    one = df.where("vec_id = 1")
    assert [(r.whitened, r.explained, r.deviation) for r in whitening.whiten(one, whitening.fit_whitening(one)).collect()] == [(None, 0.0, 0)] * 4
    far = spark.createDataFrame([(i, [1e300 * i, 1.0 - i]) for i in range(4)], "vec_id bigint, embedding array<double>")
    assert {r.deviation for r in whitening.whiten(far, whitening.fit_whitening(far)).collect()} == {None}


@pytest.mark.parametrize("dim,wanted,largest", [(300, 32, 90), (120, 5, 20), (64, 32, None), (10, 10, None), (3, 1, None)])
def test_eigenpairs(dim, wanted, largest):
    dealt = np.random.default_rng(dim)
    spread = np.linalg.qr(dealt.normal(size=(dim, dim)))[0]
    true = np.sort(dealt.exponential(size=dim))[::-1]
    a = (spread * true) @ spread.T
    a = (a + a.T) / 2
    passes = []
    values, found, worst = whitening.eigenpairs(lambda x: passes.append(x.shape[1]) or a @ x, dim, wanted, largest)
    assert np.abs(values - true[:wanted]).max() < 1e-12 * true[0] * dim and worst < 1e-11 * true[0]
    assert np.abs(found.T @ found - np.eye(wanted)).max() < 1e-12
    assert np.linalg.norm(a @ found - found * values, axis=0).max() < 1e-11 * true[0]
    if dim == 300:
        assert max(passes) <= 40 and len(passes) > 10  # the subspace never was the whole space


def test_eigenpairs_of_equal_and_zero_values():
    for a in (np.zeros((6, 6)), np.eye(6), np.diag([5.0, 5, 5, 1, 0, 0])):
        values, found, _ = whitening.eigenpairs(lambda x, a=a: a @ x, 6, 4)
        assert np.allclose(values, np.sort(np.diag(a))[::-1][:4]) and np.allclose(found.T @ found, np.eye(4))


def test_minres():
    dealt = np.random.default_rng(1)
    a = dealt.normal(size=(30, 30))
    a = a + a.T  # indefinite
    right = dealt.normal(size=(30, 4))
    right[:, 2] = 0
    x = whitening.minres(lambda v: a @ v, right, 80)
    assert np.abs(a @ x - right).max() < 1e-6
    sizes = [np.linalg.norm(a @ whitening.minres(lambda v: a @ v, right, k) - right, axis=0) for k in range(12)]
    assert all((after <= before + 1e-9).all() for before, after in zip(sizes, sizes[1:], strict=False))


# --- prefix trie ---------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 400), st.randoms(use_true_random=False))
def test_find_close(pairs, dealt):
    opens, depth, left = [True], 1, pairs
    while depth:
        up = left and (dealt.random() < 0.6 or depth == 1)
        opens.append(bool(up))
        depth += 1 if up else -1
        left -= bool(up)
    opens = np.array(opens)
    stack, close = [], {}
    for k, o in enumerate(opens):
        if o:
            stack.append(k)
        else:
            close[stack.pop()] = k
    at = np.flatnonzero(opens)
    assert prefix_trie.Parens(opens).find_close(at).tolist() == [close[k] for k in at.tolist()]


def nodes(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256)
                  for r in df.collect())


SCHEMA = "conv_id bigint, turn int, role string, text string, n_convs int, path string, shard int, node string, depth int"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, "p", 2, "n", 3) for r in rows], SCHEMA)


def test_trie_query_over_conversations(spark, small):
    given = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert nodes(entry.queries()["op13_prefix_trie"](spark, small)) == brute.trie(given)


@pytest.mark.parametrize("shard_nodes", [4, 60, 100_000])
def test_trie_of_odd_rows_in_shards(spark, shard_nodes):
    dealt = random.Random(shard_nodes)
    rows = []
    for c in [*range(0, 60), 10**12, 10**12 + 3, 2**53 + 1, 2**53 + 2]:
        for t in range(dealt.randint(0, 9)):
            rows.append((c, t if dealt.random() < 0.9 else None, dealt.choice(["user", "assistant", "", None]), dealt.choice(["a", "é" * 3, "", None, "long " * 50])))
    rows += [(c, t, "user", f"same {t}") for c in range(200, 300) for t in range(4)]  # equal conversations
    rows += [(400, t, "user", "x") for t in range(40)] + [(401, t, "user", "x") for t in range(60)]
    rows += rows[:5] + [(None, 1, "user", "no conversation")]
    got = nodes(prefix_trie.prefix_trie(prefix_trie.rebuild(conversations(spark, rows)), shard_nodes))
    assert got == brute.trie(rows)


def test_trie_of_no_and_of_one_conversation(spark):
    none = conversations(spark, [(1, 1, "user", "x")]).limit(0)
    assert prefix_trie.prefix_trie(prefix_trie.rebuild(none)).collect() == []
    for rows in ([(5, None, None, None)], [(-3, 1, "user", "x"), (-(2**63), 1, "user", "x")]):
        assert nodes(prefix_trie.prefix_trie(prefix_trie.rebuild(conversations(spark, rows)))) == brute.trie(rows)


def test_trie_sql(spark, small):
    """The registered SQL states the same as the plain version."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{small}/conversations.parquet')")
    names = "conv_id, depth, coalesce(parent_conv_id, -1), n_convs, n_children, n_leaves, saved_tokens, ends_sha256"
    got = sorted(con.execute(f"SELECT {names} FROM ({entry.oracle_sql()['op13_prefix_trie']})").fetchall())
    assert got == brute.trie(con.execute("SELECT conv_id, turn, role, text FROM conversations").fetchall())


def test_a_worker_keeps_the_tables_of_one_operator():
    made = []
    first = T.kept("a", lambda: made.append("a") or [1])
    assert T.kept("a", lambda: made.append("again") or [2]) is first
    T.kept("b", lambda: made.append("b") or [3])
    assert T.kept("a", lambda: made.append("a") or [4]) == [4] and made == ["a", "b", "a"]
    T.kept(None)
    assert T.kept("a", lambda: [5]) == [5]
    T.kept(None)
