"""Main text of web pages: markup, and a suffix array over the pages of each host.

A page is cut into blocks of text. What markup names as menu, header, footer, sidebar, notice,
advert, form, script, style or reader comment goes; where it names an article (or else a main part),
all else goes too. The token streams of a host's pages are joined into one sequence, whose suffix
array ranks every place by its next ``RUN`` tokens; equal ranks on distinct pages are repeated runs.

Where nothing is marked, tokens that a run of ``PAGES`` distinct pages covers go, and the unique runs
between them stay. Inside a marked article only whole blocks go: those of ``RUN`` tokens or more that
stand in the articles of at least ``PAGES`` pages and ``HOST_PERCENT`` percent of the host's, counting
the pages of which ``OWN_PERCENT`` percent of the tokens stand nowhere else. So copies and near copies
of one article never take each other's text, and text in a menu or advert takes none from an article.
An article of which nothing would be left stays whole.

A run's pages are counted over its whole host; pages of equal tokens count as one. A host of up to
``GROUP`` pages and ``GROUP_BYTES`` is judged in one task. A larger host is not brought together: its
blocks are counted by hash, and so are the windows of ``RUN`` tokens of pages without a marked part, in
shards, and the pages look theirs up. So that few hashes are shuffled, cells of hashes are counted
first, and only windows whose cell has ``PAGES`` of them are counted with their pages. Both ways give
the same texts.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratamart.llm import text as T
from stratamart.llm.arrays import Arrays, StoredIds, local_path, packed, runs, shard_of, store
from stratamart.session import scratch_path, stable

RUN, PAGES, GROUP, GROUP_BYTES = 8, 3, 512, 32 << 20
HOST_PERCENT, OWN_PERCENT = 50, 40
SHARD_BYTES = 32 << 20
TASK_WINDOWS = 1_000_000
CELL_BITS = 24

_TAG = re.compile(r"<!--.*?(?:-->|$)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_SPACE = {"br", "td", "th", "option", "img", "wbr"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "legend", "li", "main", "menu", "nav",
    "ol", "p", "pre", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul",
}
_DROPPED = {"nav", "footer", "aside", "form", "menu", "button", "select", "dialog", "svg", "canvas", "object", "audio", "video", "head", "label", "fieldset"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner", "nav", "navbar",
    "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "sidenav", "footer", "masthead", "topbar", "cookie", "cookies", "consent", "gdpr", "notice",
    "notices", "notification", "comment", "comments", "disqus", "respond", "replies", "share", "sharing", "social", "related", "recommended", "newsletter",
    "subscribe", "signup", "login", "popup", "modal", "overlay", "pagination", "pager", "widget", "toolbar", "skip", "copyright",
}
_OUTSIDE_NAMES = {"header", "head", "toc"}


def _dropped(name: str, attributes: str, in_article: bool) -> bool:
    if name in _DROPPED or (name == "header" and not in_article):
        return True
    if not attributes.strip():
        return False
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), (a or b or c).lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "role" and value in _ROLES):
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if key in ("class", "id") and name not in ("body", "html", "article", "main"):
            words = set(re.split(r"[^a-z0-9]+", value))
            if words & _NAMES or ("side" in words and "bar" in words) or (not in_article and words & _OUTSIDE_NAMES):
                return True
        if key in ("class", "id") and name == "article" and set(re.split(r"[^a-z0-9]+", value)) & {"comment", "comments", "ad", "related", "promo"}:
            return True
    return False


def blocks_of(page: str | None) -> list[tuple[str, str]]:
    """``(kind, text)`` of the blocks in page order; kind is ``article``, ``main``, ``open`` or ``template``."""
    page = page or ""
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, str | None]] = []  # element, kind that it sets
    kinds: list[str] = ["open"]
    parts: list[str] = []

    def close() -> None:
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            out.append((kinds[-1], text))

    def pop() -> None:
        _, kind = stack.pop()
        if kind:
            kinds.pop()

    at = 0
    while True:
        tag = _TAG.search(page, at)
        text = page[at:tag.start() if tag else len(page)]
        if text:
            parts.append(html.unescape(text) if "&" in text else text)
        if not tag:
            break
        at = tag.end()
        if tag[2] is None:
            continue
        name = tag[2].lower()
        if not tag[1]:
            if name in _RAW:
                end = re.compile(f"</{name}\\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
                continue
            if name in _SPACE:
                parts.append(" ")
            kind = None
            if name not in _VOID:
                now = kinds[-1]
                if now != "template":
                    if _dropped(name, tag[3], now == "article"):
                        kind = "template"
                    elif name == "article":
                        kind = "article"
                    elif name == "main" and now == "open":
                        kind = "main"
            if name in _BLOCK or kind:
                close()
            if name == "p":  # a paragraph ends the one before it
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p":
                        while len(stack) > k:
                            pop()
                        break
                    if stack[k][0] in _BLOCK:
                        break
            if name not in _VOID and not tag[3].rstrip().endswith("/"):
                stack.append((name, kind))
                if kind:
                    kinds.append(kind)
        else:
            if name in _BLOCK or any(n == name and k for n, k in stack):
                close()
            elif name in _SPACE:
                parts.append(" ")
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    while len(stack) > k:
                        pop()
                    break
    close()
    return out


def judged_blocks(page: str | None) -> tuple[list[str], list[bool], bool]:
    """The texts of a page's blocks, which of them may stay, and whether markup says so: those of the
    article where one is marked, else those of the main part, else those not named as template text."""
    found = blocks_of(page)
    kinds = {k for k, _ in found}
    best = "article" if "article" in kinds else "main" if "main" in kinds else "open"
    return [t for _, t in found], [k == best for k, _ in found], best != "open"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [judged_blocks(page.as_py()) for page in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:2], batch.column(3), pa.array([b for b, _, _ in found], pa.list_(pa.string())),
             pa.array([s for _, s, _ in found], pa.list_(pa.bool_())), pa.array([m for _, _, m in found], pa.bool_())],
            ["page_id", "url", "host", "blocks", "stays", "marked"])


def run_ranks(streams: list[list[str]], run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """The rank of every place of the joined streams by its next ``run`` tokens, and each stream's first
    place (one more at the end).

    Suffixes are ranked by their first 1, 2, 4, ... tokens (prefix doubling) up to ``run``, so equal
    ranks are the intervals of the suffix array whose common prefix is that long. A mark of its own
    ends each stream, so no run crosses two pages.
    """
    sizes = np.array([len(s) + 1 for s in streams])
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    flat = [t for s in streams for t in [*s, ""]]
    number: dict[str, int] = {}
    rank = np.fromiter((number.setdefault(t, len(number)) for t in flat), np.int64, len(flat)) + len(streams)
    rank[bounds[1:] - 1] = np.arange(len(streams))
    n, length = len(rank), 1
    while length < run:
        step = min(length, run - length)
        after = np.full(n, -1, np.int64)
        after[:n - step] = rank[step:]
        order = np.lexsort((after, rank))
        new = np.ones(n, np.int64)
        new[0] = 0
        new[1:] = (rank[order][1:] != rank[order][:-1]) | (after[order][1:] != after[order][:-1])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        length += step
    return rank, bounds


def covered_tokens(streams: list[list[str]], run: int = RUN, pages: int = PAGES) -> list[np.ndarray]:
    """For each stream, which tokens lie in a run of ``run`` tokens found in ``pages`` streams."""
    if not streams:
        return []
    rank, bounds = run_ranks(streams, run)
    n, owner = len(rank), np.repeat(np.arange(len(streams)), np.diff(bounds))
    order = np.lexsort((owner, rank))  # suffixes by rank, the pages of each together
    starts = np.ones(n, bool)
    starts[1:] = rank[order][1:] != rank[order][:-1]
    fresh = starts.copy()
    fresh[1:] |= owner[order][1:] != owner[order][:-1]
    group = np.cumsum(starts) - 1
    often = np.bincount(group, fresh)[group] >= pages
    mark = np.zeros(n + run + 1, np.int64)
    at = order[often]
    at = at[at + run <= bounds[owner[at] + 1] - 1]  # not over the end of its stream
    np.add.at(mark, at, 1)
    np.add.at(mark, at + run, -1)
    cover = np.cumsum(mark)[:n] > 0
    return [cover[bounds[k]:bounds[k + 1] - 1] for k in range(len(streams))]


def repeated_blocks(articles: list[tuple[str, ...]], run: int = RUN) -> list[list[bool]]:
    """For each of the distinct ``articles`` (tuples of blocks), which blocks the host repeats: see the
    module's text. A block is told by the ranks of the runs that cover it, or by its text if shorter."""
    words = [[block.split() for block in article] for article in articles]
    if not words:
        return []
    rank, bounds = run_ranks([[t for block in article for t in block] for article in words], run)
    names: list[list[tuple]] = []
    for k, article in enumerate(words):
        at, own = int(bounds[k]), []
        for block in article:
            n = len(block)
            own.append((n, *rank[[*range(at, at + n - run, run), at + n - run]].tolist()) if n >= run else (n, *block))
            at += n
        names.append(own)
    pages = Counter(name for own in names for name in set(own))
    alone = [100 * sum(name[0] for name in set(own) if pages[name] == 1) >= OWN_PERCENT * sum(name[0] for name in set(own)) for own in names]
    counted = Counter(name for own, ok in zip(names, alone, strict=True) if ok for name in set(own))
    need = max(PAGES, -(-HOST_PERCENT * sum(alone) // 100))
    return [[name[0] >= run and counted[name] >= need for name in own] for own in names]


def _kept_blocks(blocks: list[str], stays: list[bool], repeated: list[bool]) -> str:
    """The article's blocks that the host does not repeat, or all where none would be left."""
    article = [block for block, stay in zip(blocks, stays, strict=True) if stay]
    kept = [block for block, gone in zip(article, repeated, strict=True) if not gone]
    return "\n".join(kept or article)


def _unique_text(blocks: list[str], stays: list[bool], covered: np.ndarray) -> str:
    """The tokens of the blocks that may stay, without those that a repeated run covers."""
    kept, at = [], 0
    for block, stay in zip(blocks, stays, strict=True):
        words = block.split()
        unique = [w for w, c in zip(words, covered[at:at + len(words)], strict=True) if not c] if stay else []
        at += len(words)
        if unique:
            kept.append(" ".join(unique))
    return "\n".join(kept)


def _judge(group: pd.DataFrame) -> pd.DataFrame:
    """The texts of the pages of one host."""
    pages = list(zip(group["blocks"], group["stays"], group["marked"], strict=True))
    articles = [tuple(b for b, stay in zip(blocks, stays, strict=True) if stay) if marked else None for blocks, stays, marked in pages]
    # pages of equal tokens are one, wherever their blocks begin
    first: dict[tuple, tuple] = {}
    for article in articles:
        if article is not None:
            first.setdefault(tuple(t for block in article for t in block.split()), article)
    repeated = dict(zip(first, repeated_blocks(list(first.values())), strict=True))
    known = {name: {block: gone for block, gone in zip(first[name], flags, strict=True)} for name, flags in repeated.items()}
    streams, covered = [], {}
    if any(article is None for article in articles):
        streams = [tuple(t for b in blocks for t in b.split()) for blocks in group["blocks"]]
        distinct = list(dict.fromkeys(streams))
        covered = dict(zip(distinct, covered_tokens([list(s) for s in distinct]), strict=True))
    texts = []
    for k, ((blocks, stays, _), article) in enumerate(zip(pages, articles, strict=True)):
        if article is None:
            texts.append(_unique_text(blocks, stays, covered[streams[k]]))
        else:
            gone = known[tuple(t for block in article for t in block.split())]
            texts.append(_kept_blocks(blocks, stays, [gone.get(block, False) for block in article]))
    return pd.DataFrame({"page_id": group["page_id"].astype("Int64"), "url": group["url"], "text": pd.Series(texts, dtype=object, index=group.index)})


def _page_windows(batch: pa.RecordBatch) -> Iterator[tuple[int, list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of pages the first row, the judged blocks, the hashes of their windows (with the host),
    each page's first window and first token, and the hash of each page's tokens."""
    found = [judged_blocks(page.as_py()) for page in batch.column(2)]
    hosts = batch.column(4).to_numpy(zero_copy_only=False).view(np.uint64)
    for row, stop, data, offsets in T.slices(pa.array([" ".join(blocks) for blocks, _, _ in found], pa.string())):
        starts, ends, first = T.word_spans(data, offsets)
        prefix = T.prefix_hash(data)
        hashes, bounds = T.windows(T.span_hash(prefix, starts, ends), first, RUN)
        hashes = T.mix(hashes + np.repeat(T.mix(hosts[row:stop]), np.diff(bounds))).view(np.int64)
        yield row, found[row:stop], hashes, bounds, first, T.span_hash(prefix, offsets[:-1], offsets[1:]).view(np.int64)


def _few_pages(hashes: np.ndarray, pages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ``(hash, page)``, in order; of each hash ``PAGES`` pages at most, which is all that is asked."""
    order = np.lexsort((pages, hashes))
    hashes, pages = hashes[order], pages[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (pages[1:] != pages[:-1])
    hashes, pages = hashes[fresh], pages[fresh]
    few = np.ones(len(hashes), bool)
    few[PAGES:] = hashes[PAGES:] != hashes[:-PAGES]
    return hashes[few], pages[few]


def _cell(hashes: np.ndarray) -> np.ndarray:
    return (hashes.view(np.uint64) >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def _send_windows(shards: int, folder: str | None):
    """Without ``folder`` rows ``(shard, cells)`` of a task's windows, one cell for each window and
    page; with it ``(shard, hashes, pages)`` of the windows whose cell is marked there."""

    def flush(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        hashes, pages = _few_pages(*(np.concatenate(x) for x in zip(*held, strict=True)))
        shard = shard_of(hashes, shards)
        if folder:
            rows = [(s, *parts) for s, parts in packed(shard, [hashes, pages])]
        else:
            cells = _cell(hashes)
            order = np.lexsort((cells, shard))
            rows = []
            for s, e in runs(shard[order]):
                # steps between cells in order, by byte place, leave little to store
                steps = np.diff(cells[order[s:e]], prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4)
                rows.append((int(shard[order[s]]), zlib.compress(np.ascontiguousarray(steps.T).tobytes(), 1), b""))
        columns = list(zip(*rows, strict=True)) or [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["shard", "hashes", "pages"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, held, size = Arrays(folder) if folder else None, [], 0
        for batch in batches:
            for _, _, hashes, bounds, _, contents in _page_windows(batch):
                pages = np.repeat(contents, np.diff(bounds))
                if marks:
                    known = np.zeros(len(hashes), bool)
                    shard, cells = shard_of(hashes, shards), _cell(hashes)
                    for s in np.unique(shard):
                        at, bits = np.flatnonzero(shard == s), marks.array(f"cells-{s}")
                        known[at] = (bits[cells[at] >> 3] >> (7 - (cells[at] & 7)) & 1) > 0
                    hashes, pages = hashes[known], pages[known]
                held.append((hashes, pages))
                size += len(hashes)
                if size >= TASK_WINDOWS:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return run


def _mark_cells(folder: str):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        shard = int(group["shard"].iloc[0])
        counts = np.zeros(1 << CELL_BITS, np.uint8)
        for sent in group["hashes"]:
            steps = np.ascontiguousarray(np.frombuffer(zlib.decompress(sent), np.uint8).reshape(4, -1).T).view("<u4").ravel()
            cells = np.cumsum(steps, dtype=np.int64)
            for _ in range(PAGES):  # each round counts every cell once more that is still there
                if len(cells):
                    fresh = np.append(True, cells[1:] != cells[:-1])
                    counts[cells[fresh]] = np.minimum(counts[cells[fresh]] + 1, PAGES)
                    cells = cells[~fresh]
        store(folder, f"cells-{shard}", np.packbits(counts >= PAGES))
        return pd.DataFrame({"n": [int((counts >= PAGES).sum())]})

    return run


def _keep_repeated(folder: str):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        hashes, _ = _few_pages(*(np.frombuffer(b"".join(group[c]), np.int64) for c in ("hashes", "pages")))
        often = np.unique(hashes[PAGES - 1:][hashes[PAGES - 1:] == hashes[:len(hashes) - PAGES + 1]])
        store(folder, f"repeated-{int(group['shard'].iloc[0])}", often)
        return pd.DataFrame({"n": [len(often)]})

    return run


def _block_hashes(host: int, blocks: list[str]) -> np.ndarray:
    """Hashes of a host's blocks by their tokens."""
    data = [" ".join(block.split()).encode() for block in blocks]
    bounds = np.cumsum([0, *map(len, data)])
    hashes = T.span_hash(T.prefix_hash(np.frombuffer(b"".join(data), np.uint8)), bounds[:-1], bounds[1:])
    return T.mix(hashes + T.mix(np.array([host]).view(np.uint64))).view(np.int64)


def _article_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(host_hash, page, block, n)``: the blocks of marked articles by hash, with their tokens; a page
    without a marked part gives a row without a block."""
    for batch in batches:
        out: list[tuple] = []
        for page, host in zip(batch.column(2), batch.column(4).to_pylist(), strict=True):
            blocks, stays, marked = judged_blocks(page.as_py())
            article = [b for b, stay in zip(blocks, stays, strict=True) if stay] if marked else []
            if not marked:
                out.append((host, None, None, 0))
            elif article:
                own = int(_block_hashes(host, [" ".join(article)])[0])
                out += [(host, own, h, len(b.split())) for h, b in zip(_block_hashes(host, article).tolist(), article, strict=True)]
        columns = list(zip(*out, strict=True)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["host_hash", "page", "block", "n"])


def _repeated_hashes(cells: DataFrame) -> DataFrame:
    """``(id)``: the hashes of the blocks that hosts repeat, by the rule of ``repeated_blocks``."""
    page = ["host_hash", "page"]
    # a block on one page only is told by its count, so no row is joined by its block
    single = cells.groupBy("host_hash", "block").agg(F.count("*").alias("pages"), F.min("page").alias("page"), F.min("n").alias("n")).where("pages = 1")
    own = single.groupBy(*page).agg(F.sum("n").alias("own"))
    alone = stable(cells.groupBy(*page).agg(F.sum("n").alias("n")).join(own, page).where(f"100 * own >= {OWN_PERCENT} * n").select(*page))
    need = alone.groupBy("host_hash").agg(F.greatest(F.lit(PAGES), F.ceil(F.count("*") * HOST_PERCENT / 100)).alias("need"))
    counted = cells.where(f"n >= {RUN}").join(alone, ["host_hash", "page"], "left_semi").groupBy("host_hash", "block").agg(F.count("*").alias("pages"))
    return counted.join(need, "host_hash").where("pages >= need").select(F.col("block").alias("id"))


def _judge_large(pages: DataFrame) -> DataFrame:
    """The texts of pages of hosts too large for a task."""
    cells = stable(pages.mapInArrow(_article_blocks, "host_hash bigint, page bigint, block bigint, n bigint").distinct())
    repeated = StoredIds(_repeated_hashes(cells.where("block IS NOT NULL")))
    size = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    folder = local_path(scratch_path(pages.sparkSession, "template"))
    # the windows of all pages are counted if some page has no marked part; only there they decide
    plain = not cells.where("block IS NULL").isEmpty()
    sent = "shard bigint, hashes binary, pages binary"
    for send, keep in ((_send_windows(shards, None), _mark_cells(folder)), (_send_windows(shards, folder), _keep_repeated(folder))) if plain else ():
        pages.mapInArrow(send, sent).groupBy("shard").applyInPandas(keep, "n bigint").agg(F.sum("n")).collect()

    def article_text(host: int, ids: Arrays, blocks: list[str], stays: list[bool]) -> str:
        article = [block for block, stay in zip(blocks, stays, strict=True) if stay]
        gone = repeated.has(ids, _block_hashes(host, article)) if article else []
        return _kept_blocks(blocks, stays, [bool(g) and len(t.split()) >= RUN for g, t in zip(gone, article, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, ids = Arrays(folder), Arrays(repeated.folder)
        for batch in batches:
            hosts, texts = batch.column(4).to_pylist(), []
            if not plain:
                for host, page in zip(hosts, batch.column(2), strict=True):
                    texts.append(article_text(host, ids, *judged_blocks(page.as_py())[:2]))
            for row, found, hashes, bounds, first, _ in _page_windows(batch) if plain else ():
                edge = np.zeros(first[-1] + 1, np.int64)
                token = np.arange(len(hashes)) + np.repeat(first[:-1] - bounds[:-1], np.diff(bounds))
                for _, at, _ in marks.places("repeated", shard_of(hashes, shards), hashes):
                    np.add.at(edge, token[at], 1)
                    np.add.at(edge, token[at] + RUN, -1)
                covered = np.cumsum(edge) > 0
                for k, ((blocks, stays, marked), a, b) in enumerate(zip(found, first[:-1], first[1:], strict=True)):
                    texts.append(article_text(hosts[row + k], ids, blocks, stays) if marked else _unique_text(blocks, stays, covered[a:b]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return pages.mapInArrow(run, "page_id bigint, url string, text string")


def main_text(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every row of ``pages(page_id, url, html)``.

    A null or empty page gives an empty text, a null url counts as one host of its own, repeated
    rows are all returned, and other columns are not read. A page is parsed whole, however long; of
    the blocks that markup lets stay, what the host repeats goes as the module's text says.
    """
    host = F.regexp_replace(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    host = F.lower(F.substring_index(F.substring_index(host, "/", 1), "@", -1))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html", host.alias("host")).withColumn("host_hash", F.xxhash64("host"))
    # stored, so that its size is known and texts are not shuffled to be joined with it
    large = stable(rows.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.octet_length("html")).alias("size"))
                   .where(f"n > {GROUP} OR size > {GROUP_BYTES}").select("host"))
    small = rows.join(large, "host", "left_anti").select(rows.columns)
    result = small.mapInArrow(_parse, "page_id bigint, url string, host string, blocks array<string>, stays array<boolean>, marked boolean") \
        .groupBy("host").applyInPandas(_judge, "page_id bigint, url string, text string")
    if large.limit(1).count():
        result = result.unionByName(_judge_large(rows.join(large, "host", "left_semi").select(rows.columns)))
    return result.withColumn("n_chars", F.length("text").cast("bigint"))
