"""Repeated passages, the language model, line quality, licences, vectors and pages."""

import hashlib
import math
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict
from pathlib import Path
from types import SimpleNamespace

import brute
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from stratamart.llm import html_extract, licences, line_crf, metric_join, ngram_lm, suffix_dedup
from stratamart.llm.text import slices

DOC = "doc_id bigint, text string"


def removed(text, covered):
    data, gone = (text or "").encode(), set(covered)
    spans = sum(k - 1 not in gone for k in gone)
    kept = bytes(b for k, b in enumerate(data) if k not in gone)
    return len(data), len(gone), spans, hashlib.sha256(kept).hexdigest()


def test_repeated_bytes(spark, documents, texts):
    found = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.repeated_bytes(documents).collect()}
    plain = brute.repeated_bytes(texts)
    assert found == {i: removed(t, plain[i]) for i, t in texts.items()}


def test_repeated_bytes_planted(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randrange(1, 6)))
    passage = " ".join(word() for _ in range(120)).encode()
    rows = []
    for i in range(60):
        at, n = rng.randrange(150), rng.choice([150, 199, 200, 201, 230, 300])
        rows.append((i, " ".join(word() for _ in range(rng.randrange(60))) + passage[at:at + n].decode() + " ".join(word() for _ in range(30))))
    rows += [(100, "ab" * 400), (101, "x" * 5000), (102, "x" * 199), (103, "é" * 90 + "z" * 30), (104, None), (105, ""), (106, "q" * 200)]
    found = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.repeated_bytes(spark.createDataFrame(rows, DOC)).collect()}
    plain = brute.repeated_bytes(dict(rows))
    assert found == {i: removed(t, plain[i]) for i, t in rows}


def test_repeated_bytes_tricky(spark, tricky):
    assert suffix_dedup.repeated_bytes(tricky).count() == tricky.count()
    assert suffix_dedup.repeated_bytes(tricky.limit(0)).count() == 0
    kept = suffix_dedup.without_repeats(tricky)
    assert kept.columns == tricky.columns and kept.count() == tricky.count()


def test_repeats_store_arrays_only(spark, documents):
    """An executor that writes a table starts a process for every file's rights; counts asked once need no table."""
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:")) / "stratamart"
    before = set(shared.glob("*")) if shared.exists() else set()
    suffix_dedup.find_repeats(documents)
    assert [p.name.split("-")[0] for p in set(shared.glob("*")) - before] == ["repeats"]


def test_workers_of_passages_hold_little(tmp_path, monkeypatch):
    """A worker keeps the room it once took: arrays are given on without copies, counts have 32 bits."""
    monkeypatch.setattr(suffix_dedup.T, "_powers", [np.ones(1, np.uint64)] * 2)
    letters = np.frombuffer(b"abcdefghijklmnop", np.uint8)[np.random.default_rng(7).integers(0, 16, 12 << 20)]
    batch = pa.record_batch({"doc_id": range(96), "text": [t.tobytes().decode() for t in letters.reshape(96, -1)]})

    def most(run, given):
        tracemalloc.start()
        try:
            return list(run(iter([given]))), tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    found, counted = most(suffix_dedup._count_fragments(3), batch.select(["text"]))
    (rows,) = found
    fragments = sum(len(x) for x in rows.column("counts").to_pylist())
    assert rows.column("shard").to_pylist() == [0, 1, 2]
    assert [len(x) // 8 for x in rows.column("hashes").to_pylist()] == [len(x) // 32 for x in rows.column("bands").to_pylist()]
    assert counted < 300 * fragments  # of 49 bytes each, with the tables of powers and what a run takes
    assert len(suffix_dedup.T._powers[0]) <= 1 << 19

    repeats = suffix_dedup.Repeats(str(tmp_path), 1, 1)
    monkeypatch.setattr(suffix_dedup, "find_repeats", lambda docs: repeats)
    docs = SimpleNamespace(select=lambda *c: SimpleNamespace(mapInArrow=lambda run, schema: run))
    run = suffix_dedup.repeated_bytes(docs)
    found, marked = most(run, batch)
    assert sum(b.num_rows for b in found) == 96
    assert marked < 20 * suffix_dedup.T.SLICE_BYTES


def test_column_wise_bwt():
    texts = [b"banana", b"ananas", b"", b"nab", b"banana"]
    suffixes = sorted(((tuple(t[p:]), 0 if p == len(t) else 1, i, p) for i, t in enumerate(texts) for p in range(len(t) + 1)),
                      key=lambda s: ([b + 300 for b in s[0]] + [s[2]]))
    want = [texts[i][p - 1] if p else suffix_dedup.MARK for _, _, i, p in suffixes]
    assert suffix_dedup.column_wise_bwt(texts).tolist() == want


def test_transform_is_not_rewritten_every_round(monkeypatch):
    rng = random.Random(5)
    texts = [bytes(rng.choices(b"abcdefgh ", k=rng.randrange(200, 337))) for _ in range(200)]
    written, joined = [], suffix_dedup._joined
    monkeypatch.setattr(suffix_dedup, "_joined", lambda *x: written.append(len(joined(*x))) or joined(*x))
    transform = suffix_dedup.column_wise_bwt(texts)
    total = len(transform)
    assert total == sum(map(len, texts)) + len(texts) and written[-1] == total
    assert sum(written) < 30 * total  # every round would make about 135


@pytest.mark.parametrize("limit", [1, 20_000, 1 << 20])
def test_collections_by_anchor(tmp_path, monkeypatch, limit):
    """Fragments of many anchors, in collections of one and of several anchors, against plain windows."""
    rng = random.Random(6)
    passages = ["".join(rng.choices("ab ", k=400)) for _ in range(90)] + ["ab" * 300, "x" * 700, "~@AB" * 150]
    texts = ["".join(rng.choices("ab ", k=9)) + p[a:a + rng.randrange(190, 320)] + rng.choice("ab ") * 3 for p in passages for a in (0, 3, 40)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    found = suffix_dedup.Fragments(data, np.cumsum([0, *map(len, texts)]))
    raw = data.tobytes()
    group = pd.DataFrame({"cell": 0, "hash": found.hash, "anchor": found.anchor,
                          "before": [raw[a:b] for a, b in zip(found.start, found.place, strict=True)],
                          "after": [raw[a + suffix_dedup.ANCHOR:b] for a, b in zip(found.place, found.end, strict=True)]})
    sizes = []
    windows = suffix_dedup.repeated_windows
    monkeypatch.setattr(suffix_dedup, "repeated_windows", lambda t, n: sizes.append(sum(map(len, t))) or windows(t, n))
    monkeypatch.setattr(suffix_dedup, "COLLECTION_BYTES", limit)
    suffix_dedup._resolve(str(tmp_path))(group)
    assert (len(sizes) > 1) == (limit < 1 << 20)
    # a fragment found twice counts once here: its second place is known before
    spans = {h: raw[a:b] for h, a, b in zip(found.hash.tolist(), found.start, found.end, strict=True)}
    count = Counter(b[k:k + 200] for b in spans.values() for k in range(len(b) - 199))
    want = {h: [count[b[k:k + 200]] > 1 for k in range(len(b) - 199)] for h, b in spans.items()}
    keys, bits = np.load(tmp_path / "partial-0.npy"), np.load(tmp_path / "partial-bits-0.npy")
    assert sorted(keys) == keys.tolist() == sorted(h for h, x in want.items() if any(x))
    for h, own in zip(keys.tolist(), bits, strict=True):
        assert np.unpackbits(own)[:len(want[h])].tolist() == want[h]


def plain_model(texts, held):
    docs = {i: [*brute.WORD.findall(brute.lower(t or "")), None] for i, t in texts.items()}
    pairs, words = Counter(), Counter()
    for i, ws in docs.items():
        if i not in held:
            pairs.update(zip(["<s>", *ws], ws))
            words.update(ws)
    kinds, after = Counter(), defaultdict(list)
    for (v, w), c in pairs.items():
        kinds[w] += 1
        after[v].append(c)
    of = lambda values: [sum(x == k for x in values) for k in (1, 2, 3, 4)]
    d2, d1 = ngram_lm.discounts(of(list(pairs.values()))), ngram_lm.discounts(of(list(kinds.values())))
    cut = lambda c, d: max(c - ([0, *d][min(c, 3)]), 0)
    K, V, N = len(pairs), len(words), sum(words.values())
    rest = sum([0, *d1][min(k, 3)] for k in kinds.values()) / K

    def p(v, w):
        low = cut(kinds[w], d1) / K + rest / (V + 1)
        if v not in after:
            return low
        s = sum(after[v])
        return cut(pairs[v, w], d2) / s + sum([0, *d2][min(c, 3)] for c in after[v]) / s * low

    return {i: (len(ws), sum(w in words for w in ws), N, sum(math.log10((words[w] + 0.5) / (N + 0.5 * (V + 1))) for w in ws),
                sum(math.log10(p(v, w)) for v, w in zip(["<s>", *ws], ws))) for i, ws in docs.items()}, p, [*words, "unknown"]


def test_language_model(spark, documents, texts):
    held = {i for i in texts if zlib.crc32(str(i).encode()) % 5 == 1}
    want, p, words = plain_model(texts, held)
    for size in (1 << 16, ngram_lm.SHARD_BYTES):
        rows = ngram_lm.language_model_scores(documents, size).collect()
        assert {r.doc_id for r in rows if r.held_out} == held
        for r in rows:
            n, known, total, base, score = want[r.doc_id]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
            assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-9)
    assert sum(p("the", w) for w in words) == pytest.approx(1)
    assert sum(r.score for r in rows if r.held_out) > sum(r.base_score for r in rows if r.held_out)


def test_language_model_tricky(spark, tricky):
    rows = ngram_lm.language_model_scores(tricky).collect()
    assert len(rows) == tricky.count() and all(math.isfinite(r.score) for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (0, 1, 2)} == {1}
    assert ngram_lm.language_model_scores(tricky.limit(0)).count() == 0


def auc(score, label):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    pos = label == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_line_quality(spark, tricky):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    scored = line_crf.line_quality(docs, labels)
    rows = [r for r in scored.join(labels, "doc_id").collect() if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    score, label = np.array([r.score for r in rows]), np.array([r.quality for r in rows])
    assert auc(score, label) > 0.95 and np.mean([r.predicted == r.quality for r in rows]) > 0.9
    odd = line_crf.line_quality(tricky, labels).collect()
    assert len(odd) == tricky.count() and all(0 <= r.score <= 1 for r in odd)
    assert line_crf.line_quality(tricky.limit(0), labels.limit(0)).count() == 0


def test_marginals_by_enumeration():
    rng = np.random.default_rng(1)
    x, first = rng.standard_normal((5, 3)), np.array([0, 0, 4, 5])
    field = line_crf.Field(rng.standard_normal(3), rng.standard_normal((2, 2)), 0.5)
    want = []
    for a, b in ((0, 4), (4, 5)):
        total, good = 0.0, np.zeros(b - a)
        for code in range(2 ** (b - a)):
            y = [(code >> k) & 1 for k in range(b - a)]
            s = math.exp(sum(y[k] * (x[a + k] @ field.weights) for k in range(b - a)) + sum(field.changes[y[k], y[k + 1]] for k in range(b - a - 1)))
            total += s
            good += np.array(y) * s
        want += (good / total).tolist()
    assert line_crf.marginals(field, x, first) == pytest.approx(want)


def test_licences(spark):
    mit = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software. The above copyright notice and this permission "
           "notice shall be included in all copies.\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY\nOF ANY KIND. Enjoy.")
    rows = [(1, "Some text\nLicensed under the Apache License, Version 2.0."), (2, mit), (3, "Licensed under CC BY-NC 4.0. Released under the MIT License."),
            (4, "This work is licensed under the GNU General Public License, version 3."), (5, "A license nobody knows. Other text."), (6, None), (7, ""), (8, "plain " * 5000)]
    found = {r.doc_id: (r.licences, r.n_sentences, r.n_unknown) for r in licences.licence_scan(spark.createDataFrame(rows, DOC)).collect()}
    assert found == {1: ("Apache-2.0", 1, 0), 2: ("MIT", 3, 0), 3: ("CC-BY-NC-4.0,MIT", 2, 0), 4: ("GPL-3", 1, 0), 5: ("", 1, 1), 6: ("", 0, 0), 7: ("", 0, 0), 8: ("", 0, 0)}


def test_licences_without_a_licence_word(spark):
    rows = [("CC-BY-SA-4.0", "Available under CC BY-SA 4.0."), ("CC-BY-4.0", "Creative\nCommons Attribution 4.0"), ("GPL-2", "Released under the GPL v2."),
            ("CC-BY-NC-ND-3.0", "Text (CC BY-NC-ND 3.0) here"), ("CC-BY-NC-SA-2.5", "cc by-nc-sa 2.5"), ("CC-BY-NC-4.0", "Under CC BY-NC v4.0"), ("CC-BY-ND-4.0", "CC BY-ND 4.0"),
            ("", "Neither the name of X nor of Y may be used to endorse or promote products."), ("Public-Domain", "It is in the public\ndomain."), ("", "Nothing of the GPL here.")]
    found = {r.doc_id: r for r in licences.licence_scan(spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], DOC)).collect()}
    assert [found[k].licences for k in range(len(rows))] == [x for x, _ in rows]
    assert found[7].sentence_ids == "BsdEndorse" and all(r.n_unknown == 0 for r in found.values()) and found[9].n_sentences == 0


def test_every_licence_of_a_sentence(spark, tmp_path):
    """Planted sentences, in Spark and by the registered SQL."""
    import duckdb

    planted = {
        "dual licensed under the MIT License or the Apache License, Version 2.0": "Apache-2.0,MIT",
        "Licensed under the Apache License, Version 2.0\nLicensed under the MIT License": "Apache-2.0,MIT",
        "// SPDX-License-Identifier: MIT OR Apache-2.0\nint main": "apache-2.0,mit",
        "SPDX-License-Identifier: (GPL-2.0-only WITH Classpath-exception-2.0) AND BSD-3-Clause.": "bsd-3-clause,classpath-exception-2.0,gpl-2.0-only",
        "Copyright (c) 2020 Some One all rights reserved": "All-Rights-Reserved",
        "Released under the MIT License and the BSD license, text under CC BY-SA 4.0": "BSD,CC-BY-SA-4.0,MIT",
        "Available under CC BY 4.0.": "CC-BY-4.0", "A license nobody knows": "", "": "", "no such word": "",
    }
    rows = [(k, t) for k, t in enumerate(planted)] + [(99, None), (3, "plain")]
    found = licences.licence_scan(spark.createDataFrame(rows, DOC)).select("doc_id", "sentence_ids", "licences", "n_sentences", "n_unknown")
    got = sorted((tuple(r) for r in found.collect()), key=repr)
    assert {r[0]: r[2] for r in got if r[0] != 3} == {k: x for k, x in [*enumerate(planted.values()), (99, "")] if k != 3}
    assert [r[1] for r in got if r[0] == 0] == ["MitRef,ApacheRef:2.0"]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert sorted(con.execute(licences.oracle()).fetchall(), key=repr) == got
    assert licences.licence_scan(spark.createDataFrame([], DOC)).collect() == []


def test_licences_against_sql(spark, tricky, small):
    from compare import compare, duckdb_tables

    assert compare(spark, duckdb_tables(small), "op1_license_scan", small) is None
    assert licences.licence_scan(tricky).count() == tricky.count()


def plain_vectors(rows, least=0.93):
    unit = {}
    for k, (_, v, label) in enumerate(rows):
        if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float32).astype(float)
            unit[k] = x / np.linalg.norm(x)
    links = [(a, b) for a in unit for b in unit if a < b and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= least]
    comp = brute.components({r[0] for r in rows}, [(rows[a][0], rows[b][0]) for a, b in links])
    count = Counter(k for p in links for k in p)
    return sorted((r[0], count[k], comp[r[0]]) for k, r in enumerate(rows))


def test_vectors(spark, small, monkeypatch):
    df = spark.read.parquet(f"{small}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    want = plain_vectors(rows)
    for block in (2048, 40):
        monkeypatch.setattr(metric_join, "BLOCK", block)
        got = sorted((r.vec_id, r.n_links, r.component_id) for r in metric_join.near_vectors(df).collect())
        assert got == want


def test_vectors_tricky(spark, monkeypatch):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(2)
    base = rng.standard_normal(8)
    rows = [(k, [float(x) for x in base + 0.3 * rng.standard_normal(8)], 1) for k in range(120)]
    rows += [(200, None, 1), (201, [0.0] * 8, 1), (202, [nan] + [1.0] * 7, 1), (203, [inf] + [1.0] * 7, 1), (204, [None] + [1.0] * 7, 1), (205, [], 1), (206, rows[0][1], None),
             (207, rows[0][1], 2), (208, rows[0][1], 1), (209, rows[0][1], 1), (210, [1.0, 2.0], 1), (211, [2.0, 4.0], 1)]
    monkeypatch.setattr(metric_join, "BLOCK", 16)
    df = spark.createDataFrame([(*r, 7) for r in rows], "vec_id bigint, embedding array<float>, label int, cell int")
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in metric_join.near_vectors(df).collect()) == plain_vectors(rows)
    assert metric_join.near_vectors(df.limit(0)).count() == 0


PAGE = ("<html><head><title>T</title><style>p{{}}</style><script>var a='</p><p>no</p>';</script></head><body><header>Head</header><nav><ul><li>Home</li></ul></nav>"
        "<div class=\"ad banner\">Buy <div>now</div></div><article><h1>Title &amp;  more</h1><p>One<br>two&nbsp;three<p>Four <b>five</b> < six</p>"
        "<div id=comments><p>I say</p></div><aside>side</aside></article><form>name</form><footer>&copy; x</footer>")


def test_pages(spark):
    words = [f"w{k}" for k in range(400)]
    rng = random.Random(1)
    menu = "Home News Sports Weather Travel Food Culture Opinion Contact Imprint"
    rows = [(1, "http://a.example/1", PAGE.format()), (2, None, None), (3, "x", ""), (4, "http://a.example/4", "<main><p>in main</p></main><p>outside</p>"), (5, "http://a.example/5", "no markup &lt; here")]
    for k in range(10, 16):
        own = " ".join(rng.choice(words) for _ in range(30))
        rows.append((k, f"https://U@B.example/{k}", f"<div><div>{menu}</div><div>{own}</div><div>{menu} tail{k}</div></div>"))
    df = spark.createDataFrame([(*r, "h") for r in rows], "page_id bigint, url string, html string, host string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.main_text(df).collect()}
    assert got[1][0] == "Title & more\nOne two three\nFour five < six"
    assert got[2] == ("", 0) and got[3] == ("", 0) and got[4][0] == "in main" and got[5][0] == "no markup < here"
    for k, _, page in rows[5:]:
        own = page.split("</div><div>")[1]
        assert got[k][0] == f"{own}\ntail{k}"
    assert html_extract.main_text(df.limit(0)).count() == 0


def test_template_text_inside_articles(spark):
    share = "Send this story to all your friends and neighbours today"
    rows = [(k, f"http://h.example/{k}", f"<nav>Home</nav><{tag}><p>own words of page{k}</p><p>{share}</p><p>page{k} ends here</p></{tag}>")
            for k, tag in enumerate(["article", "main", "article", "main"])]
    got = {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {k: f"own words of page{k}\npage{k} ends here" for k in range(4)}


def plain_main_texts(pages):
    """{page_id: text} of marked pages by the rule for whole blocks, counted with dictionaries."""
    found = {i: (url.split("//")[1].split("/")[0].lower(), [b for b, stay in zip(*html_extract.judged_blocks(page)[:2]) if stay]) for i, url, page in pages}
    out = {}
    for host in {h for h, _ in found.values()}:
        articles = {tuple(" ".join(a).split()): a for h, a in found.values() if h == host}
        holds = {}
        for name, article in articles.items():
            for block in set(article):
                holds.setdefault(block, set()).add(name)
        size = lambda blocks: sum(len(b.split()) for b in blocks)
        own = {name for name, a in articles.items() if size({b for b in a if len(holds[b]) == 1}) >= 0.4 * size(set(a))}
        need = max(3, -(-len(own) // 2))
        gone = {b for b, names in holds.items() if len(b.split()) >= 8 and len(names & own) >= need}
        for i, (h, a) in found.items():
            if h == host:
                out[i] = "\n".join([b for b in a if b not in gone] or a)
    return out


@pytest.mark.parametrize("group", [512, 5])
def test_pages_of_the_table(spark, small, monkeypatch, group):
    """Every page of the table against the plain rule, with hosts judged in a task and by hashes."""
    monkeypatch.setattr(html_extract, "GROUP", group)
    pages = spark.read.parquet(f"{small}/pages.parquet")
    given = [tuple(r) for r in pages.select("page_id", "url", "html").collect()]
    got = {r.page_id: r.text for r in html_extract.main_text(pages).collect()}
    assert got == plain_main_texts(given)
    marked = {i for i, _, page in given if html_extract.judged_blocks(page)[2]}
    assert len(marked) > 0.9 * len(given) and all(got[i] for i in marked)


@pytest.mark.parametrize("group", [512, 3])
def test_articles_keep_what_is_theirs(spark, monkeypatch, group):
    """Near copies take nothing from each other, menus nothing from articles, and no block is cut."""
    monkeypatch.setattr(html_extract, "GROUP", group)
    rng = random.Random(11)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    notice, story, menu = words(12), [words(100) for _ in range(3)], words(15)
    bodies = [[story[0], story[1], f"{story[2]} changed{k}"] for k in range(3)]  # near copies
    bodies += [[words(40), notice, words(30), "de " * (20 + k)] for k in range(8)]  # a notice that the host repeats
    bodies += [[menu, words(50), "Summary"], [notice], [words(40), f"{notice} and more of this page", "Summary"]]
    rows = [(k, f"http://one.example/{k}", f"<nav>{menu}</nav><article>{''.join(f'<p>{b}</p>' for b in body)}</article>") for k, body in enumerate(bodies)]
    df = spark.createDataFrame(rows + [(99, "http://one.example/plain", f"<div>{menu}</div><div>{words(20)}</div>")], "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in html_extract.main_text(df).collect()}
    for k, body in enumerate(bodies):
        assert got[k] == "\n".join(b.strip() for b in body if b != notice or body == [notice]), k


def test_large_host_and_copies(spark, monkeypatch):
    rng = random.Random(3)
    share = [" ".join(f"s{j}x{k}" for k in range(9)) for j in range(30)]
    own = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(20)) for _ in range(90)]
    body = {k: f"<div>{own[k]}</div><div>{share[k % 30]}</div><div>tail{k}</div>" for k in range(90)}
    rows = [(k, "http://big.example/" + str(k), body[k]) for k in range(90)]
    rows += [(100 + k, "http://big.example/copy", body[0]) for k in range(4)] + [(200 + k, "http://copy.example/", body[0]) for k in range(4)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    want = {k: f"{own[k]}\ntail{k}" for k in range(90)} | {100 + k: f"{own[0]}\ntail0" for k in range(4)}
    want |= {200 + k: f"{own[0]}\n{share[0]}\ntail0" for k in range(4)}
    for group, size in ((512, 1 << 20), (16, 1 << 20), (2, 2000)):
        monkeypatch.setattr(html_extract, "GROUP", group)
        monkeypatch.setattr(html_extract, "SHARD_BYTES", size)
        assert {r.page_id: r.text for r in html_extract.main_text(df).collect()} == want


def test_covered_tokens_by_enumeration():
    rng = random.Random(7)
    streams = [[rng.choice("ab") for _ in range(rng.randrange(30))] for _ in range(9)]
    found = html_extract.covered_tokens(streams, 5, 3)
    seen = defaultdict(set)
    for k, s in enumerate(streams):
        for i in range(len(s) - 4):
            seen[tuple(s[i:i + 5])].add(k)
    for s, cover in zip(streams, found):
        want = set()
        for i in range(len(s) - 4):
            if len(seen[tuple(s[i:i + 5])]) >= 3:
                want.update(range(i, i + 5))
        assert set(np.flatnonzero(cover)) == want


def test_slices_keep_texts_whole():
    column = pa.array(["a" * 10, None, "", "b" * 500, "é"])
    got = [(row, stop, data.tobytes()) for row, stop, data, _ in slices(column, 50)]
    assert b"".join(d for _, _, d in got) == b"a" * 10 + b"b" * 500 + "é".encode() and got[0][0] == 0 and got[-1][1] == 5
