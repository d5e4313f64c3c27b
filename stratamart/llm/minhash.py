"""Near-duplicate documents: a signature-coordinate inverted join, confirmed on full sets.

Every distinct shingle set is posted under ``(coordinate, value)`` of its MinHash signature.
Two sets of the wanted similarity or more agree in at least ``matches`` of the first ``COORDINATES``
coordinates (chance of less: under 1e-5), so they share one of any ``COORDINATES - matches + 1``
of them. A set is posted under that many, those of its rarest values (prefix); a value that
only one set has joins nothing, and what is not in the prefix is skipped. Collisions are
counted over all ``SIGNATURE`` coordinates and pairs under ``threshold`` matches are dropped
(chance for a true pair: under 1e-5); the rest are confirmed on the sets themselves.

Only components are asked for, so no group is expanded into pairs: first every posting list is
joined with its most central member (that with the commonest values). Members in its component
by then need no more work; the others are compared, in blocks of ``BLOCK`` sets, with all
members of their list that are in another component. The blocks give at most one link per set.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratamart.llm import text as T
from stratamart.llm.arrays import Arrays, StoredIds
from stratamart.llm.components import components
from stratamart.session import stable

WORDS, PERCENT = 5, 85
COORDINATES, SIGNATURE = 32, 128
BLOCK = 256


def sure_matches(coordinates: int, p: float, chance: float = 1e-5) -> int:
    """The most matches, each of probability ``p``, that are missed with less than ``chance``."""
    under = 0.0
    for k in range(coordinates + 1):
        under += math.comb(coordinates, k) * p**k * (1 - p) ** (coordinates - k)
        if under >= chance:
            return k
    return coordinates


@dataclass(frozen=True)
class Similarity:
    """A least similarity in percent and what follows from it for signatures."""

    percent: int = PERCENT

    @property
    def matches(self) -> int:
        return sure_matches(COORDINATES, self.percent / 100)

    @property
    def prefix(self) -> int:
        return COORDINATES - self.matches + 1

    @property
    def threshold(self) -> int:
        return sure_matches(SIGNATURE, self.percent / 100 + (1 - self.percent / 100) / 256)  # of low bytes


_seeds = np.random.default_rng(20240601).integers(0, 1 << 63, (2, SIGNATURE), np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, past the last row, shingle hashes, bounds)``, repeats included."""
    for row, stop, data, offsets in T.slices(column, T.RUN_BYTES):
        data = T.lower(data)
        starts, ends, first = T.word_spans(data, offsets)
        words = T.span_hash(T.prefix_hash(data), starts, ends)
        hashes, bounds = T.windows(words, first, WORDS)
        counts = np.diff(first)
        short = np.flatnonzero((counts > 0) & (counts < WORDS))
        if len(short):  # the whole sequence is the one shingle; its length is part of the hash
            own = np.zeros(len(short), np.uint64)
            for k in range(WORDS - 1):
                has = counts[short] > k
                own[has] = T.mix(own[has] + words[first[short[has]] + k] + np.uint64(k + 1))
            hashes = np.insert(hashes, bounds[short], own)
            extra = np.zeros(len(bounds), np.int64)
            extra[short + 1] = 1
            bounds = bounds + np.cumsum(extra)
        yield row, stop, hashes, bounds


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    T.kept(None)
    for batch in batches:
        ids = batch.column(0)
        for row, stop, hashes, bounds in shingles(batch.column(1)):
            n = stop - row
            sizes, sums, xors = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for k in range(n):
                if bounds[k] < bounds[k + 1]:
                    own = np.unique(hashes[bounds[k]:bounds[k + 1]])
                    sizes[k] = len(own)
                    sums[k] = own.sum().view(np.int64)
                    xors[k] = np.bitwise_xor.reduce(T.mix(own + np.uint64(1))).view(np.int64)
            some = np.flatnonzero(sizes)
            signature = np.zeros((n, SIGNATURE), np.uint32)
            if len(some):
                at = bounds[:-1][some]
                for c in range(SIGNATURE):
                    value = ((hashes ^ _seeds[0, c]) * _seeds[1, c]) >> np.uint64(32)
                    signature[some, c] = np.minimum.reduceat(value.astype(np.uint32), at)
            low = (signature ^ (signature >> np.uint32(11))).astype(np.uint8)
            values = signature[:, :COORDINATES].astype(np.int64) | (np.arange(COORDINATES, dtype=np.int64) << 32)
            yield pa.RecordBatch.from_arrays([
                ids.slice(row, n), pa.array(sizes), pa.array(sums), pa.array(xors),
                pa.FixedSizeBinaryArray.from_buffers(pa.binary(SIGNATURE), n, [None, pa.py_buffer(low.tobytes())]).cast(pa.binary()),
                pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * COORDINATES), pa.array(values.ravel())),
            ], ["doc_id", "n", "s1", "s2", "low", "keys"])


def _sets(needed: StoredIds):
    """The shingle sets of the needed ids; texts of others are passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = Arrays(needed.folder)
        for batch in batches:
            ids = batch.column(0)
            known = needed.has(arrays, ids.fill_null(0).to_numpy(zero_copy_only=False)) & ids.is_valid().to_numpy(zero_copy_only=False)
            if not known.any():
                continue
            batch = batch.filter(pa.array(known))
            for row, stop, hashes, bounds in shingles(batch.column(1)):
                own = [np.unique(hashes[bounds[k]:bounds[k + 1]]).view(np.int64) for k in range(stop - row)]
                sizes = np.zeros(len(own) + 1, np.int32)
                np.cumsum([len(x) for x in own], out=sizes[1:])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, stop - row), pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(own)))],
                    ["rep", "hashes"])

    return run


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def _fits(group: pd.DataFrame, least: Similarity) -> tuple[pd.DataFrame, pd.DataFrame, np.ndarray, np.ndarray]:
    """The asking and the other sets of one block of one posting list, their matches over the whole
    signature, and which pairs may link two components. A pair that meets in several lists is taken
    up in the first of its common prefix coordinates only."""
    c = int(group["key"].iloc[0]) >> 32
    ask, all_ = group[group["asks"]], group[~group["asks"]]
    low = [np.frombuffer(b"".join(x["low"]), np.uint8).reshape(-1, SIGNATURE) for x in (ask, all_)]
    comps, n = ([x[k].to_numpy() for x in (ask, all_)] for k in ("comp", "n"))
    alike = np.zeros((len(ask), len(all_)), np.int16)
    for i in range(len(ask)):
        alike[i] = (low[1] == low[0][i]).sum(1)
    fits = (alike >= least.threshold) & (comps[0][:, None] != comps[1]) & (
        100 * np.minimum(n[0][:, None], n[1]) >= least.percent * np.maximum(n[0][:, None], n[1]))
    if c and fits.any():
        prefix = []
        for x in (ask, all_):
            own = np.full((len(x), c), -1, np.int64)
            for i, keys in enumerate(x["prefix"]):
                for key in keys:
                    if key >> 32 < c:
                        own[i, key >> 32] = key
            prefix.append(own)
        for i in np.flatnonzero(fits.any(1)):
            fits[i] &= ~((prefix[1] == prefix[0][i]) & (prefix[0][i] >= 0)).any(1)
    return ask, all_, alike, fits


def block_rows(group: pd.DataFrame, least: Similarity) -> pd.DataFrame:
    """The rows of a block that may link with another of it; only their sets have to be read."""
    ask, all_, _, fits = _fits(group, least)
    return pd.concat([ask[fits.any(1)], all_[fits.any(0)]], ignore_index=True)


def block_links(group: pd.DataFrame, least: Similarity) -> pd.DataFrame:
    """Links of a block that join different components; at most one for each set."""
    ask, all_, alike, fits = _fits(group, least)
    sets = [[np.asarray(v) for v in x["hashes"]] for x in (ask, all_)]
    ids, comps = ([x[k].to_numpy() for x in (ask, all_)] for k in ("rep", "comp"))
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        while (up := parent.get(v, v)) != v:
            parent[v] = parent.get(up, up)
            v = up
        return v

    found = []
    for i in range(len(ask)):
        near = np.flatnonzero(fits[i])
        for j in near[np.argsort(-alike[i, near], kind="stable")]:
            x, y = root(int(comps[0][i])), root(int(comps[1][j]))
            if x != y and _linked(sets[0][i], sets[1][j], least.percent):
                parent[max(x, y)] = min(x, y)
                found.append((ids[0][i], ids[1][j]))
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row of ``docs(doc_id, text)``, linked
    from a similarity of ``percent`` on.

    Null and empty texts and texts of white space have no shingle and link with nothing, not even
    each other; fewer words than five make one shingle. Rows without a ``doc_id`` link with
    nothing and get a null component. Repeated rows are all returned. Other columns are not read.
    """
    signed = stable(docs.select("doc_id", "text").mapInArrow(
        _signatures, "doc_id bigint, n bigint, s1 bigint, s2 bigint, low binary, keys array<bigint>"))
    usable = signed.where("n > 0 AND doc_id IS NOT NULL")
    # equal sets have equal signatures
    classes = stable(usable.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"), F.first("low").alias("low"), F.first("keys").alias("keys")))
    links = stable(_links(docs, classes.select("rep", "n", "low", "keys").dropDuplicates(["rep"]), Similarity(percent)))
    found = components(links)
    of_class = classes.join(found, classes["rep"] == found["id"], "left").select(
        "n", "s1", "s2", F.coalesce("component", "rep").alias("component"))
    return signed.select("doc_id", "n", "s1", "s2").join(
        of_class, ["n", "s1", "s2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component"))).otherwise(F.col("doc_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _links(docs: DataFrame, first: DataFrame, least: Similarity) -> DataFrame:
    """Links that join the same classes as all links of the least similarity or more do."""
    posts = first.select("rep", F.explode("keys").alias("key"))
    common = posts.groupBy("key").agg(F.count("*").alias("sets")).where("sets > 1")
    # values of one set only come first in its prefix and join nothing
    ranked = posts.join(common, "key").groupBy("rep").agg(
        F.sort_array(F.collect_list(F.struct("sets", "key"))).alias("by_rarity"), F.sum("sets").alias("weight")) \
        .where(F.size("by_rarity") >= least.matches) \
        .select("rep", "weight", F.expr(
            f"transform(slice(by_rarity, 1, {least.prefix} - ({COORDINATES} - size(by_rarity))), x -> x.key)").alias("prefix"))
    candidates = stable(ranked.join(first.drop("keys"), "rep"))
    lists = stable(candidates.select("rep", "weight", F.explode("prefix").alias("key")))
    centres = lists.groupBy("key").agg(F.max(F.struct("weight", "rep"))["rep"].alias("centre"), F.count("*").alias("members")).where("members > 1")
    centres = stable(centres)
    needed = lists.join(centres, "key", "left_semi").select("rep").distinct()
    sets = stable(docs.select("doc_id", "text").mapInArrow(
        _sets(StoredIds(needed.select(F.col("rep").alias("id")))), "rep bigint, hashes array<bigint>").dropDuplicates(["rep"]))
    pairs = lists.join(centres, "key").where("rep <> centre").select("rep", "centre").distinct()
    size = first.select("rep", "n")
    pairs = stable(pairs.join(size, "rep").join(size.select(F.col("rep").alias("centre"), F.col("n").alias("m")), "centre")
                   .where(f"100 * least(n, m) >= {least.percent} * greatest(n, m)").select("rep", "centre"))
    near = pairs.join(sets, "rep").join(
        sets.select(F.col("rep").alias("centre"), F.col("hashes").alias("others")), "centre") \
        .withColumn("common", F.size(F.array_intersect("hashes", "others"))) \
        .where(f"100 * common >= {least.percent} * (size(hashes) + size(others) - common)")
    star = stable(near.select(F.col("rep").alias("a"), F.col("centre").alias("b")))
    comps = components(star)
    labelled = lists.join(comps, lists["rep"] == comps["id"], "left").select("rep", "key", F.coalesce("component", "rep").alias("comp"))
    main = labelled.join(centres, "key")
    centre_comp = main.where("rep = centre").select("key", F.col("comp").alias("main_comp"))
    main = main.join(centre_comp, "key").withColumn("asks", F.col("comp") != F.col("main_comp"))
    asking = main.where("asks").groupBy("key").agg(F.count("*").alias("askers"))
    opened = main.join(asking, "key").select("rep", "key", "comp", "asks", F.expr(f"int(ceil(members / {BLOCK}))").alias("blocks"),
                                             F.expr(f"int(ceil(askers / {BLOCK}))").alias("ask_blocks"))
    opened = stable(opened)
    own = F.expr("int(pmod(xxhash64(rep), blocks))")
    ask_own = F.expr("int(pmod(xxhash64(rep, 7), ask_blocks))")
    every = lambda n: F.expr(f"sequence(0, {n} - 1)")
    rows = opened.where("asks").select("rep", "key", "comp", F.lit(True).alias("asks"), ask_own.alias("q"), F.explode(every("blocks")).alias("block")).union(
        opened.select("rep", "key", "comp", F.lit(False).alias("asks"), F.explode(every("ask_blocks")).alias("q"), own.alias("block")))
    block = ["key", "q", "block"]
    light = rows.join(candidates.select("rep", "n", "low", "prefix"), "rep")
    near = stable(light.groupBy(*block).applyInPandas(lambda g: block_rows(g, least), light.schema))
    more = near.join(sets, "rep").groupBy(*block).applyInPandas(lambda g: block_links(g, least), "a bigint, b bigint")
    return star.union(more)
