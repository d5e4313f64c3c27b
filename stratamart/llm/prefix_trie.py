"""Prefix trie of conversations, as balanced parentheses per shard.

A conversation is the sequence of its turns' hashes (its path). Paths are range-sorted, so a shard
holds neighbouring ones and a node's members are a run of rows, however many share a first turn or
are equal. Each shard writes its trie as parentheses in pre-order; blocks of them keep the least
excess, in a tree of minima, so ``find_close`` delimits all subtrees at once, the rank of ``()``
counts their leaves, and differences of cumulative arrays give members and savings.

Only nodes on the first and the last path of a shard (its spine) can be in other shards too. A node
that goes on in the next shard is counted there: as a child, as a leaf and with its own bytes. So
the shards' sums of a spine node add up; they are merged by node and handed back to the shards, whose
other nodes may have spine nodes as parents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratamart.session import stable

SHARED_TURNS, GROUP = 9, 5  # up to 8 turns are taken from the first conversation of 5
SHARD_NODES = 1 << 16
STEP = 16  # bytes of a turn's hash
PIECE = 16_000  # characters of a list of ids in one row
NO_ENDS = hashlib.sha256(b"").hexdigest()
WIDTH = 64  # parentheses in a block


def rebuild(conversations: DataFrame) -> DataFrame:
    """``(conv_id, path, sizes)``: the rebuilt turns of every conversation, as the hashes of (role,
    text) one after the other and the UTF-8 bytes of each text.

    A conversation begins with the first ``crc32(conv_id) % 9`` turns of the first one of its five
    (those it has; none if it is absent) and goes on with its own turns after as many. Turns are in
    the order of ``turn``, nulls first; rows of one ``turn`` in that of their hashes, so repeated rows
    are turns of their own. A null role or text is empty. Rows without a ``conv_id`` are left out.
    Texts stay where they are read, only their hashes are shuffled. Other columns are not read.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    hashed = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * STEP)
    turn = F.struct(F.col("turn").isNotNull().alias("placed"), F.coalesce(F.col("turn").cast("bigint"), F.lit(0)).alias("turn"),
                    hashed.alias("step"), F.octet_length(text).cast("bigint").alias("bytes"))
    own = stable(conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("bigint").alias("conv_id"), turn.alias("t"))
                 .groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")))
    shared = SHARED_TURNS - 1
    heads = own.where(f"pmod(conv_id, {GROUP}) = 0").select(F.col("conv_id").alias("base"), F.expr(f"slice(turns, 1, {shared})").alias("head"))
    taken = own.withColumns({"base": F.expr(f"try_subtract(conv_id, pmod(conv_id, {GROUP}))"),
                             "h": F.expr(f"int(crc32(cast(cast(conv_id AS string) AS binary)) % {SHARED_TURNS})")})
    turns = F.expr("concat(slice(coalesce(head, slice(turns, 1, 0)), 1, h), slice(turns, h + 1, size(turns)))")
    return taken.join(heads, "base", "left").withColumn("turns", turns).select(
        "conv_id", F.unhex(F.array_join(F.col("turns.step"), "")).alias("path"), F.col("turns.bytes").alias("sizes"))


class Parens:
    """Balanced parentheses (True opens) in blocks of ``WIDTH`` with a tree of least excesses."""

    def __init__(self, opens: np.ndarray) -> None:
        n = len(opens)
        blocks = max(1, -(-n // WIDTH))
        steps = np.ones(blocks * WIDTH, np.int8)  # what pads the end never closes
        steps[:n] = np.where(opens, 1, -1)
        self.opens = opens
        self.inside = np.cumsum(steps.reshape(blocks, WIDTH), axis=1, dtype=np.int8)
        self.base = np.zeros(blocks, np.int64)
        np.cumsum(self.inside[:-1, -1], out=self.base[1:])
        self.least = [self.base + self.inside.min(axis=1)]
        while len(self.least[-1]) > 1:
            low = self.least[-1]
            low = np.append(low, np.iinfo(np.int64).max) if len(low) % 2 else low
            self.least.append(np.minimum(low[0::2], low[1::2]))
        self.opened = np.zeros(n + 1, np.int64)
        np.cumsum(opens, out=self.opened[1:])
        self.leaves = np.zeros(n + 1, np.int64)
        np.cumsum(opens & ~np.append(opens[1:], False), out=self.leaves[1:])

    def excess(self, at: np.ndarray) -> np.ndarray:
        return self.base[at // WIDTH] + self.inside[at // WIDTH, at % WIDTH]

    def _in_block(self, block: np.ndarray, target: np.ndarray, after: np.ndarray) -> np.ndarray:
        """The first place of each block after ``after`` whose excess is ``target``, or -1."""
        out = np.full(len(block), -1, np.int64)
        for k in range(0, len(block), 1 << 15):
            part = slice(k, k + (1 << 15))
            hit = (self.inside[block[part]] == (target - self.base[block])[part, None]) & (np.arange(WIDTH) > after[part, None])
            found = hit.any(axis=1)
            out[part] = np.where(found, block[part] * WIDTH + hit.argmax(axis=1), -1)
        return out

    def find_close(self, at: np.ndarray) -> np.ndarray:
        """Where each parenthesis opened at ``at`` closes: the next place of an excess lower by one."""
        target = self.excess(at) - 1
        close = self._in_block(at // WIDTH, target, at % WIDTH)
        rest = np.flatnonzero(close < 0)
        node, level = (at // WIDTH)[rest], np.zeros(len(rest), np.int64)
        going = np.arange(len(rest))
        for k, low in enumerate(self.least):  # up, until a tree to the right has it
            own = node[going]
            right = own + 1
            has = (own % 2 == 0) & (right < len(low))
            has[has] = low[right[has]] <= target[rest[going[has]]]
            node[going] = np.where(has, right, own // 2)
            level[going[has]] = k
            going = going[~has]
        assert not len(going), "the parentheses are not balanced"
        for k in range(len(self.least) - 1, 0, -1):  # down, to the first block that has it
            down = np.flatnonzero(level == k)
            left = 2 * node[down]
            node[down] = np.where(self.least[k - 1][left] <= target[rest[down]], left, left + 1)
            level[down] = k - 1
        close[rest] = self._in_block(node, target[rest], np.full(len(rest), -1))
        return close


def _least_in(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least of ``values[low:high]`` for each pair, by runs of doubling length."""
    out = np.zeros(len(low), np.int64)
    level = np.frexp((high - low).astype(np.float64))[1] - 1
    runs, length = values, 1
    for k in range(int(level.max(initial=0)) + 1):
        own = np.flatnonzero(level == k)
        out[own] = np.minimum(runs[low[own]], runs[high[own] - length])
        if len(runs) > length:
            runs = np.minimum(runs[:-length], runs[length:])
        length *= 2
    return out


def _common(a: bytes, b: bytes) -> int:
    """Turns that two paths begin with."""
    n = min(len(a), len(b)) // STEP
    x, y = (np.frombuffer(p[:n * STEP], np.uint64).reshape(n, 2) for p in (a, b))
    other = np.flatnonzero((x != y).any(axis=1))
    return int(other[0]) if len(other) else n


def _keys(path: bytes) -> list[str]:
    """The keys of the nodes of a path, from the root's on."""
    out = [""]
    for k in range(0, len(path), STEP):
        out.append(hashlib.sha256(out[-1].encode() + path[k:k + STEP]).hexdigest()[:2 * STEP])
    return out


class Shard:
    """The trie of sorted paths. Nodes are numbered in pre-order, the root is 0. ``following`` is the
    first path of the next shard, if there is one."""

    def __init__(self, conv: np.ndarray, paths: list[bytes], sizes: np.ndarray, following: bytes | None) -> None:
        n = len(paths)
        self.conv, self.paths = conv, paths
        length = np.array([len(p) // STEP for p in paths], np.int64)
        begin = np.cumsum(length) - length
        common = self._common_with_previous(b"".join(paths), length, begin)
        new = length - common
        total = 1 + int(new.sum())
        row = np.repeat(np.arange(n), new)
        first = 1 + np.cumsum(new) - new
        self.depth = np.zeros(total, np.int64)
        self.depth[1:] = np.arange(1, total) - first[row] + common[row] + 1
        own = np.zeros(total, np.int64)
        own[1:] = sizes[begin[row] + self.depth[1:] - 1] if total > 1 else 0
        # parentheses: each row closes what it does not share with the one before, then opens its own
        closed = np.append(np.append(0, length[:-1]) - common, length[-1] + 1)
        opened = np.append(new, 0)
        opens = np.repeat(np.tile([False, True], n + 1), np.stack([closed, opened], 1).ravel())
        parens = Parens(np.append(True, opens))
        at = np.flatnonzero(parens.opens)
        close = parens.find_close(at)
        node = np.arange(total)
        after = parens.opened[close]  # the subtree of a node is node..after - 1
        end = np.where(new > 0, first + new - 1, 0)
        end = np.maximum.accumulate(end)  # a repeated path ends where the one before it did
        ending = np.bincount(end, minlength=total)
        before = np.append(0, np.cumsum(ending))
        self.row_from, self.row_to = before[:-1], before[1:]  # rows that end at the node
        self.members = before[after] - before[node]
        self.least = _least_in(conv, before[node], before[after])
        order = self.depth * (total + 1)
        ranked = np.sort(order + node)
        self.parent = ranked[np.maximum(np.searchsorted(ranked, order - (total + 1) + node) - 1, 0)] % (total + 1)
        self.parent[0] = -1
        # nodes that go on in the next shard are on the last path
        chain = [int(end[-1])]
        while chain[-1]:
            chain.append(int(self.parent[chain[-1]]))
        self.last_path = np.array(chain[::-1])
        self.first_path = np.arange(int(length[0]) + 1)
        here = np.ones(total, bool)
        if following is not None:
            here[self.last_path[:_common(paths[-1], following) + 1]] = False
        elsewhere = bool(following is not None and not here[chain[0]] and after[chain[0]] == chain[0] + 1)
        self.leaves = parens.leaves[close] - parens.leaves[at]
        self.leaves[self.last_path] -= elsewhere
        self.children = np.bincount(self.parent[1:][here[1:]], minlength=total)
        saved = np.append(0, np.cumsum(own * (self.members - here)))
        self.saved = saved[after] - saved[node]

    @staticmethod
    def _common_with_previous(joined: bytes, length: np.ndarray, begin: np.ndarray) -> np.ndarray:
        steps = np.frombuffer(joined, np.uint64).reshape(-1, 2)
        out = np.zeros(len(length), np.int64)
        least = np.minimum(length[1:], length[:-1])
        row = np.repeat(np.arange(1, len(length)), least)
        if len(row):
            place = np.arange(len(row)) - np.repeat(np.cumsum(least) - least, least)
            differs = (steps[begin[row - 1] + place] != steps[begin[row] + place]).any(axis=1)
            some = np.flatnonzero(least)
            bound = np.where(differs, place, np.iinfo(np.int64).max)
            shared = np.minimum.reduceat(bound, (np.cumsum(least) - least)[some])
            out[some + 1] = np.minimum(shared, least[some])
        return out

    def spine(self) -> dict[int, tuple[str, str | None]]:
        """The nodes of the first and the last path, with their keys and their parents'."""
        out: dict[int, tuple[str, str | None]] = {}
        for nodes, path in ((self.first_path, self.paths[0]), (self.last_path, self.paths[-1])):
            keys = _keys(path)
            for k, v in enumerate(nodes.tolist()):
                out[v] = keys[k], keys[k - 1] if k else None
        return out

    def ends(self, node: int) -> list[str]:
        """The ids of the rows that end at a node, in order."""
        return list(map(str, self.conv[self.row_from[node]:self.row_to[node]].tolist()))


def _shard(rows: pd.DataFrame, borders: pd.DataFrame) -> Shard:
    rows = rows.sort_values(["path", "conv_id"], ignore_index=True)
    following = [p for p in borders["following"] if p is not None]
    sizes = np.concatenate([*rows["sizes"], np.zeros(0, np.int64)]).astype(np.int64)
    return Shard(rows["conv_id"].to_numpy(np.int64), [bytes(p) for p in rows["path"]], sizes, bytes(following[0]) if following else None)


_SPINE = "shard int, node string, parent string, depth bigint, conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, piece string, place bigint"
_NODES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _spine_sums(rows: pd.DataFrame, borders: pd.DataFrame) -> pd.DataFrame:
    """What a shard knows of its spine nodes, and the ids that end there in pieces."""
    names = [f.split()[0] for f in _SPINE.split(", ")]
    if rows.empty:
        return pd.DataFrame(columns=names)
    shard, number, out = _shard(rows, borders), int(rows["shard"].iloc[0]), []
    for v, (key, parent) in shard.spine().items():
        out.append((number, key, parent, *(int(x[v]) for x in (shard.depth, shard.least, shard.members, shard.children, shard.leaves, shard.saved)), None, None))
        ids, at = shard.ends(v), 0
        step = max(1, PIECE // 20)
        for at in range(0, len(ids), step):
            out.append((number, key, *[None] * 7, ",".join(ids[at:at + step]), at))
    return pd.DataFrame(out, columns=names, dtype=object).astype({c: "Int64" for c in ["shard", *names[3:9], "place"]})


def _inner_nodes(rows: pd.DataFrame, borders: pd.DataFrame) -> pd.DataFrame:
    """The nodes that are in this shard alone."""
    if rows.empty:
        return pd.DataFrame(columns=_NODES)
    shard = _shard(rows, borders)
    spine = shard.spine()
    merged = dict(zip(borders["node"], borders["conv_id"], strict=True))
    least = shard.least.copy()
    for v, (key, _) in spine.items():
        least[v] = merged[key]
    inner = np.ones(len(least), bool)
    inner[list(spine)] = False
    at = np.flatnonzero(inner)
    hashes = [hashlib.sha256(",".join(shard.ends(v)).encode()).hexdigest() if some else NO_ENDS
              for v, some in zip(at.tolist(), (shard.row_to > shard.row_from)[at].tolist(), strict=True)]
    return pd.DataFrame({"conv_id": shard.least[at], "depth": shard.depth[at], "parent_conv_id": least[shard.parent[at]],
                         "n_convs": shard.members[at], "n_children": shard.children[at], "n_leaves": shard.leaves[at],
                         "saved_tokens": shard.saved[at], "ends_sha256": pd.Series(hashes, dtype=object)})


def _hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash per node over its pieces, which come one after the other; only a state is held."""
    node, state = None, None
    out: list[tuple[str, str]] = []
    for batch in batches:
        for key, piece in zip(batch.column(0), batch.column(1), strict=True):
            key, piece = key.as_py(), piece.as_py()
            if key != node:
                if state is not None:
                    out.append((node, state.hexdigest()))
                node, state = key, hashlib.sha256()
            else:
                state.update(b",")
            state.update(piece.encode())
    if state is not None:
        out.append((node, state.hexdigest()))
    for k in range(0, len(out), 10_000):
        nodes, hashes = zip(*out[k:k + 10_000], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.string()), pa.array(hashes, pa.string())], ["node", "ends_sha256"])


def prefix_trie(paths: DataFrame, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """One row per distinct prefix of ``paths(conv_id, path, sizes)``, as ``rebuild`` gives them:
    ``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)``.

    ``conv_id`` must be unique. An empty path ends at the root. An empty table has no node, not even a
    root. A shard holds about ``shard_nodes`` turns, but never less than one whole path, which is one
    value of 16 bytes a turn. The ids that end at a spine node are hashed as a stream.
    """
    paths = stable(paths.select("conv_id", "path", "sizes"))
    turns = paths.agg(F.sum(F.size("sizes") + 1)).first()[0] or 0
    placed = stable(paths.repartitionByRange(max(1, -(-turns // shard_nodes)), "path", "conv_id")
                    .withColumn("shard", F.spark_partition_id()))
    first = placed.groupBy("shard").agg(F.min("path").alias("path"))
    # one row per shard
    borders = stable(first.select("shard", F.lead("path").over(Window.orderBy("shard")).alias("following")))
    spine = stable(placed.groupBy("shard").cogroup(borders.groupBy("shard")).applyInPandas(_spine_sums, _SPINE))
    sums = ("n_convs", "n_children", "n_leaves", "saved_tokens")
    merged = stable(spine.where("piece IS NULL").groupBy("node", "parent", "depth").agg(
        F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in sums]))
    known = spine.where("piece IS NULL").select("shard", "node").join(merged.select("node", "conv_id"), "node")
    handed = borders.select("shard", "following", F.lit(None).cast("string").alias("node"), F.lit(0).cast("bigint").alias("conv_id")).unionByName(
        known.select("shard", F.lit(None).cast("binary").alias("following"), "node", "conv_id"))
    kinds = ", ".join(f"{c} {'string' if c == 'ends_sha256' else 'bigint'}" for c in _NODES)
    inner = placed.groupBy("shard").cogroup(handed.groupBy("shard")).applyInPandas(_inner_nodes, kinds)
    pieces = spine.where("piece IS NOT NULL").repartition("node").sortWithinPartitions("node", "shard", "place").select("node", "piece")
    hashes = pieces.mapInArrow(_hash_pieces, "node string, ends_sha256 string")
    parents = merged.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    outer = merged.join(parents, "parent", "left").join(hashes, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))
    return inner.unionByName(outer.select(*_NODES))
